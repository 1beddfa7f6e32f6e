"""Encoding against the public library, decoding as an exact round trip."""

from __future__ import annotations

import base64
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from repolith.llm import encode
from repolith.llm.bpe import encoder, merge

PATH = encode.vocabulary()


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_random_texts(other):
    code, r = encoder(PATH), random.Random(1)
    pool = [chr(i) for i in [*range(0x3000), *range(0x4E00, 0x5000), *range(0x1F300, 0x1F700), *[0xFEFF, 0x200D, 0x3000] * 30] if not 0xD800 <= i < 0xE000] + list(" \n\t'stvelm") * 200
    for _ in range(3000):
        text = "".join(r.choices(pool, k=r.randint(0, 60)))
        assert code.ids(text) == other(text)
        assert code.decode(code.ids(text)) == text


def test_long_words(other):
    code = encoder(PATH)
    for text in ("中" * 3000, "aA" * 2000, " " * 5000 + "x", "中文Text字" * 500, "'s" * 400, "<|endoftext|>"):
        assert code.ids(text) == other(text)


def test_merge_without_cuts():
    code = encoder(PATH)
    for word in ("internationalisation", "编码器", "naïveté"):
        raw = word.encode()
        assert merge(raw, code.ranks) == code.ids(word)


def test_corpus(spark, other):
    d = "/root/testdata/sf0.001"
    want = {k: other(t) if t else [] for k, t in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()}
    made = encode.encode(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    assert {r["doc_id"]: list(r["ids"]) for r in made.collect()} == want
    back = {r["doc_id"]: r["text"] for r in encode.decode(made, "doc_id", "ids").collect()}
    assert all(back[k] == (t or "") for k, t in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall())
    sizes = encode.sizes(spark.read.parquet(f"{d}/documents.parquet"), {"doc_id": F.col("doc_id")}, "text")
    assert {r["doc_id"]: r["n_tokens"] for r in sizes.collect()} == {k: len(v) for k, v in want.items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "hi", "c"), (2, "x" * 200_000, "d")], "k long, t string, ids string")
    got = [(r["k"], len(r["ids"])) for r in encode.encode(df, "k", "t").collect()]
    assert sorted(got, key=str)[:3] == sorted([(1, 0), (1, 0), (None, 1), got[-1]], key=str)[:3] and len(got) == 4
    assert encode.encode(df.limit(0), "k", "t").count() == 0
