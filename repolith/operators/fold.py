"""Ordered folds over sorted groups, for semantics that windows cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one output batch.
BATCH = 8192


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]],
    schema: StructType,
) -> DataFrame:
    """Apply ``fold(key, rows)`` to each group of ``keys``, its rows in ``order``.

    One shuffle on the keys and one sort; a worker streams over its sorted
    partition, so a group is never held as a whole unless the fold itself does
    so.  ``rows`` are tuples of the columns that are not keys, in the frame's
    order; the fold returns tuples of ``schema``.  Callers whose groups have no
    bound must split them by a further key before.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    rest = [i for i, n in enumerate(names) if n not in keys]
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), out)], schema=out)

        part: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: tuple(r[i] for i in at)):
            for made in fold(key, (tuple(r[i] for i in rest) for r in group)):
                part.append(made)
                if len(part) >= BATCH:
                    yield batch(part)
                    part = []
        if part:
            yield batch(part)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
