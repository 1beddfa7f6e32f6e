"""Neighbouring rows of long groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour(df: DataFrame, key: str, order: str, value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Add ``value`` of the row before (or after) in a group of ``key`` as ``name``.

    The group is cut into consecutive ranges by the column ``range`` (whose
    order agrees with ``order``).  Within a range a window compares; the first
    row of a range gets what the nearest other range ends with, found by one
    aggregation.  Where no group is split that part of the plan is empty and
    drops out at run time.  ``order`` must be unique within a group.
    """
    own = Window.partitionBy(key, "range").orderBy(F.desc(order) if ahead else F.asc(order))
    pick = F.min_by if ahead else F.max_by
    between = Window.partitionBy(key).orderBy(F.desc("range") if ahead else F.asc("range"))
    edges = (
        df.select(key, "range", order, F.struct(value.alias("v")).alias("_v"))
        .groupBy(key, "range")
        .agg(pick("_v", order).alias("_edge"))
        .withColumn("_edge", F.lag("_edge").over(between))
        .filter(F.col("_edge").isNotNull())
    )
    marked = df.withColumn("_near", F.lag(F.struct(value.alias("v"))).over(own))
    return (
        marked.join(edges, [key, "range"], "left")
        .withColumn(name, F.coalesce("_near", "_edge")["v"])
        .withColumn(f"{name}_exists", F.coalesce("_near", "_edge").isNotNull())
        .drop("_near", "_edge")
    )
