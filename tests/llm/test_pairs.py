"""Operators on pairs and terms against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from repolith.llm import cooccur, setjoin, terms
from repolith.llm.components import components


def brute_pairs(sets, t, least):
    return {
        tuple(sorted((a, b)))
        for (a, x), (b, y) in combinations(sets.items(), 2)
        if min(len(x), len(y)) >= least and len(x & y) >= t * len(x | y)
    }


def test_similar_sets(spark):
    r = random.Random(5)
    sets = {}
    for i in range(400):
        if i and r.random() < 0.6:
            base = set(r.choice(list(sets.values())))
            for _ in range(r.randint(0, 3)):
                base ^= {f"t{int(r.paretovariate(0.7)) % 300}"}
        else:
            base = {f"t{int(r.paretovariate(0.7)) % 300}" for _ in range(r.choice([3, 4, 5, 6, 8, 12, 30, 70]))}
        sets[f"r{i:03}"] = base
    rows = [(k, sorted(v) + sorted(v)[:1], 0) for k, v in sets.items()] + [("null", None, 0), (None, ["a", "b", "c"], 0), ("empty", [], 0)]
    df = spark.createDataFrame(rows, "r string, i array<string>, class int")
    for t, least in ((Fraction(6, 10), 3), (Fraction(1, 2), 1), (Fraction(9, 10), 2)):
        got = {(x["r_a"], x["r_b"]) for x in setjoin.similar(df, "r", "i", t, least).collect()}
        assert got == brute_pairs(sets, t, least)
    assert setjoin.similar(df.limit(0), "r", "i", Fraction(6, 10)).count() == 0


def test_layout_bounds():
    layout = setjoin.Layout(Fraction(6, 10))
    for n in (1, 3, 7, 24, 25, 40, 333):
        low, high = layout.range_of(n)
        assert low <= n <= high
        for partner in range(n, layout.longest(n) + 1):
            assert n + partner - 2 * layout.common(n, partner) <= layout.apart(low, high)
            assert any(a <= n <= b for a, b in layout.ranges_from(layout.shortest(partner), partner))


def test_cooccurrence(spark):
    r = random.Random(6)
    baskets = {f"b{i}": {f"i{int(r.paretovariate(0.6)) % 60}" for _ in range(r.choice([1, 2, 5, 9, 40]))} for i in range(250)}
    rows = [(b, i, "x") for b, s in baskets.items() for i in list(s) + list(s)[:1]] + [("lone", None, "x"), (None, "i1", "x")]
    df = spark.createDataFrame(rows, "n string, i string, n_ab string")
    n = len(baskets) + 1
    single = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    for least, lift, limit in ((1, None, 2000), (2, None, 8), (5, 4, 2000), (5, 1.2, 6), (3, None, 3)):
        want = {(*p, c) for p, c in both.items() if c >= least and (lift is None or c * n >= lift * single[p[0]] * single[p[1]])}
        made = cooccur.cooccurrence(df, "n", "i", least, lift, large=limit).collect()
        assert {(x["a"], x["b"], x["n_ab"]) for x in made} == want, (least, lift, limit)
        assert all(abs(x["pmi"] - math.log(x["n_ab"] * n / single[x["a"]] / single[x["b"]])) < 1e-9 for x in made)
    assert cooccur.cooccurrence(df.limit(0), "n", "i").count() == 0


def test_pairs_that_meet_once(spark, tmp_path):
    rows = [("r1", " A", None, "dev"), ("r1", "b", "1", "dev"), ("r1", "once", "1", "dev"), ("r2", "a", "1", "dev"), ("r2", "B ", "1", "dev"), ("r3", "lone", "1", "dev")]
    spark.createDataFrame(rows, "repo_id string, name string, version string, kind string").write.parquet(str(tmp_path / "dependencies.parquet"))
    got = {(x["a"], x["b"]): (x["n_ab"], x["n_a"], x["n_b"], x["lift"]) for x in entry.queries()["p7_all"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 2, 2, 1.5), ("a", "once"): (1, 2, 1, 1.5), ("b", "once"): (1, 2, 1, 1.5)}


def test_log_entropy(spark):
    rows = [("a", "1", "fix the parser"), ("a", "1", "fix the parser twice"), ("a", "2", "Parser again"), ("b", "1", "fix lexer 修复登录"), ("b", None, "lost"), (None, "9", "lost"), ("c", "1", None), ("c", "2", "")]
    df = spark.createDataFrame(rows, "r string, u string, t string")
    got = {(x["r"], x["term"]): x for x in terms.log_entropy(df, "r", "u", "t").collect()}
    assert got["a", "parser"]["tf"] == 2 and got["a", "twice"]["tf"] == 1 and ("b", "修复登录") in got and ("b", "lost") not in got
    assert abs(got["a", "parser"]["weight"] - math.log(3)) < 1e-12  # in one record only
    spread = 1 - math.log(2) / math.log(3)  # evenly in two of three records
    assert abs(got["a", "fix"]["weight"] - math.log(2) * spread) < 1e-12 and got["a", "fix"]["records"] == 2
    assert terms.log_entropy(df.limit(0), "r", "u", "t").count() == 0


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7777, 7777)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x["node"]: x["component"] for x in components(df).collect()} == {x: find(x) for x in list(parent)}
    assert components(df.limit(0)).count() == 0
