"""Splitting keeps texts and limits; mixtures hold their shares."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repolith.llm import encode, mix, split
from repolith.llm.bpe import encoder

CODE = encoder(encode.vocabulary())


def check(text, limit, overlap):
    at = 0
    for k, (start, end, n, sep) in enumerate(split.split(text, limit, overlap, CODE)):
        assert n == CODE.count(text[start:end]) <= limit
        assert start <= at < end and (sep is None) == (k == 0)
        assert CODE.count(text[start:at]) <= overlap + 3
        at = end
    assert at == len(text)


def test_random_texts():
    r = random.Random(2)
    pool = [*"ab c. \n\n#-我们。é😀\r\t1", "\n\n", "word ", " zzzzz", "́", "```\n", "## x\n", "- "]
    for _ in range(2500):
        limit = r.randint(8, 30)
        check("".join(r.choices(pool, k=r.randint(0, 150))), limit, r.randint(0, limit - 5))


def test_no_text_is_left_out():
    """Small limits, where units need more tokens by themselves than within the text."""
    r = random.Random(11)
    pool = [*"ab c. \n\n#-我们。é😀\r\t1", "\n\n", "word ", " zzzzz", "́", "```\n", "## x\n", "- ", "   ", "'s"]
    for _ in range(6000):
        check("".join(r.choices(pool, k=r.randint(0, 60))), r.randint(6, 9), 0)


def test_boundaries():
    text = "# One\n\n" + "First sentence here. " * 20 + "\n\n# Two\n\n" + "- item of a list\n" * 20
    made = split.split(text, 110, 0, CODE)
    assert text[made[1][0] :].startswith("# Two") and made[1][3] == "section"
    assert split.split(text, 10_000, 5, CODE) == [(0, len(text), CODE.count(text), None)]
    assert split.split("", 10, 2, CODE) == []
    long_word = "中" * 4000
    check(long_word, 100, 10)
    with pytest.raises(ValueError):
        split.split("a", 5, 5, CODE)


def test_overlap_is_used():
    text = "word " * 400
    made = split.split(text, 100, 20, CODE)
    assert all(18 <= CODE.count(text[b[0] : a[1]]) <= 21 for a, b in zip(made, made[1:]))


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b " * 50, 0), (3, "a b " * 50, 0)], "piece long, t string, text int")
    rows = split.pieces(df, "text", "t", 30, 5)
    assert rows.count() == 2 * len(split.split("a b " * 50, 30, 5, CODE))
    assert split.pieces(df.limit(0), "piece", "t", 30, 5).count() == 0


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.1, 2), ("c", 0.2, 2)]


def sizes(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "A ", " a"]) if i % 3 else "b" if i % 2 else "C", r.randint(1, 400)) for i in range(6000)]
    return spark.createDataFrame(rows + [(9001, None, 5), (9002, "x", 5), (9003, "a", 0), (9004, "a", None)], "id long, source string, n long")


def test_shares(spark):
    docs, targets = sizes(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    made = mix.mix(docs, targets, "id", "source", "n")
    rows = made.collect()
    total = sum(r["copies"] * r["n"] for r in rows)
    for s, share, most in TARGETS:
        own = [r for r in rows if r["source"] == s]
        if s == "none":
            assert not own
            continue
        assert abs(sum(r["copies"] * r["n"] for r in own) / total - share / 1.0) < 0.003
        assert max(r["copies"] for r in own) <= most
        assert len({r["copies"] for r in own}) <= 2  # whole copies, and one more for those drawn
    assert not {r["id"] for r in rows} & {9001, 9002, 9003, 9004}
    assert made.exceptAll(mix.mix(docs.repartition(7), targets, "id", "source", "n")).count() == 0  # the order of rows doesn't matter
    report = {r["source"]: r for r in mix.shares(made, targets, "source", "n").collect()}
    assert report["none"]["tokens"] == 0 and abs(report["a"]["actual_share"] - 0.5) < 0.003


def test_total_and_weights(spark):
    docs, targets = sizes(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    some = mix.mix(docs, targets, "id", "source", "n", total=50_000.0)
    assert abs(some.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] - 50_000) < 700
    heavy = mix.mix(docs, targets, "id", "source", "n", total=100_000.0, weight=F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0))
    even, odd = (heavy.filter(f"source = 'a' and id % 2 = {k}").agg(F.sum("n")).first()[0] for k in (0, 1))
    assert 3 < even / odd < 5.2
    assert mix.mix(docs.limit(0), targets, "id", "source", "n").count() == 0


def test_inclusion_probability(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(400)], "id long, source string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    seen = [0] * 400
    for seed in range(12):
        for r in mix.mix(docs, targets, "id", "source", "n", total=1000.0, seed=seed).collect():
            seen[r["id"]] += 1
    assert sum(seen) == 12 * 100 and max(seen) <= 10
