"""Encoding of a corpus: ids, sizes and back to text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm.bpe import TOKENIZERS, VOCABULARY, encoder
from repolith.storage import spread

#: Texts handed to a worker's encoder at once are bounded by characters, not rows.
CHARS = 4_000_000


def vocabulary(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    """Path of a rank file; it must exist on every machine."""
    return f"{folder}/{name}"


def text_of(c: Column | str) -> Column:
    """Text whose bytes are valid UTF-8; each invalid one becomes U+FFFD."""
    return F.make_valid_utf8(c)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHARS bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    group = (np.cumsum(sizes) // CHARS).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): each text as a list of ids, without special tokens.

    Null and empty texts give an empty list.  What looks like a special token is
    ordinary text.  Repeated rows and keys stay as they are; other columns,
    whatever their names, are not read.  No shuffle.
    """
    path = path or vocabulary()
    read = spread(df.select(F.col(key).alias("k"), text_of(F.col(text)).alias("t")))
    schema = T.StructType([T.StructField("k", read.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for whole in batches:
            for b in chunks(whole, 1):
                made = [code.encode(t) if t else b"" for t in b.column(1).to_pylist()]
                offsets = np.zeros(len(made) + 1, np.int32)
                np.cumsum([len(m) // 4 for m in made], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(made), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["k", "ids"])

    return read.mapInArrow(run, schema).select(F.col("k").alias(key), "ids")


def sizes(df: DataFrame, keep: dict[str, Column], text: str, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text (null and empty: 0)."""
    path = path or vocabulary()
    read = spread(df.select(text_of(F.col(text)).alias("__text"), *(c.alias(n) for n, c in keep.items())))
    schema = T.StructType([*read.schema.fields[1:], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for whole in batches:
            for b in chunks(whole, 0):
                n = pa.array([code.count(t) if t else 0 for t in b.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=schema.names)

    return read.mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): texts of lists of ids; null gives null."""
    path = path or vocabulary()
    read = df.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("k", read.schema["k"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for b in batches:
            texts = [None if x is None else code.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return read.mapInArrow(run, schema).select(F.col("k").alias(key), "text")
