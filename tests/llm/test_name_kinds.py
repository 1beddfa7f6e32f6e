"""Recall of links by kind of variant, and precision, on made people whose names no list knows."""

from __future__ import annotations

import random
from collections import defaultdict

from repolith.llm import link

SYLLABLES = ["ba", "der", "go", "hul", "kir", "lem", "mon", "nav", "pos", "rit", "sul", "tam", "vor", "wen", "zak"]
#: Short forms that the table of common ones doesn't have.
SHORT = {"Zakwenlor": "Zeko", "Mondertam": "Mondy", "Ritvorsul": "Vorri"}


def slip(word: str, r: random.Random) -> str:
    i = r.randrange(1, len(word) - 1)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + r.choice("aeiklnrst") + word[i + 1 :], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]])


def people(seed: int, n: int):
    r = random.Random(seed)
    firsts = ["".join(r.sample(SYLLABLES, 3)).title() for _ in range(30)] + list(SHORT)
    lasts = list({"".join(r.sample(SYLLABLES, 3)).title() for _ in range(3 * n)})[:n]
    rows, kinds = [], {}
    for person, last in enumerate(lasts):
        first = firsts[person % len(firsts)]
        box = f"{first}.{last}@acme.example".lower()
        other = f"{first[0]}{last}@post.example".lower()
        variants = [
            ("plain", f"{first} {last}", box), ("plain", f"{first} {last}", other), ("reordered", f"{last}, {first}", r.choice([box, None])), ("joined", f"{first}{last}", other),
            ("initial", f"{first[0]}. {last}", r.choice([box, other])), ("title and middle name", f"Dr. {first} Q. {last}", None), ("slip", f"{slip(first, r)} {last}", r.choice([box, other])),
            ("slip", f"{first} {slip(last, r)}", other), ("slip in both words", f"{slip(first, r)} {slip(last, r)}", box), ("marks", f"{first} {last}".replace("o", "ó"), None),
        ]
        if first in SHORT:
            variants += [("short form", f"{SHORT[first]} {last}", box), ("short form elsewhere", f"{SHORT[first]} {last}", None)]
        for kind, name, mail in variants:
            kinds[len(rows)] = (person, kind)
            rows.append((len(rows), name, mail))
    return rows, kinds


def test_recall_by_kind(spark):
    rows, kinds = people(21, 150)
    df = spark.createDataFrame(rows, "node long, name string, mail string")
    entity = {r["node"]: r["entity"] for r in link.link(df, "node", "name", "mail").collect()}
    plain = defaultdict(set)
    for node, (person, kind) in kinds.items():
        if kind == "plain":
            plain[person].add(entity[node])
    found, of = defaultdict(int), defaultdict(int)
    for node, (person, kind) in kinds.items():
        of[kind] += 1
        found[kind] += entity[node] in plain[person]
    recall = {k: round(found[k] / of[k], 3) for k in of}
    print(recall)
    assert all(v >= 0.9 for v in recall.values()), recall
    persons = defaultdict(set)
    for node, (person, _) in kinds.items():
        persons[entity[node]].add(person)
    mixed = sum(len(p) > 1 for p in persons.values())
    assert mixed <= 0.01 * len(persons), mixed
