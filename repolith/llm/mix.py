"""Mixing sources to target shares of the total size.

Every document of a source is due the same number of copies (or one in
proportion to a weight).  The whole part is certain; the remaining fraction is
an inclusion probability, and the documents to get one more copy are drawn by
Pareto order sampling: they are ranked by random odds divided by inclusion
odds, and taken in this order, as far as they fit, until the source's size is
reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from repolith.operators.fold import fold_sorted

#: Most sources that may be listed; more are refused, as targets and what they are due are held by the driver.
MOST_SOURCES = 100_000
#: Documents that a bucket of ranks holds on average; the bucket in which a source's size is reached is gone through in order.
PER_BUCKET = 2000
#: With weights, the scale of a source's copies is corrected until its size is met to this part, or so many times.
EXACT, CORRECTIONS = 1e-6, 30


@dataclass
class Plan:
    """What each source is due: the total, its tokens, and its most repeats."""

    total: float
    tokens: dict[str, float]
    most: dict[str, int]


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> Plan:
    """Tokens due to each source.

    ``sizes``: source -> tokens.  ``targets``: source -> (share, most repeats).
    A source without tokens cannot take part: the others hold their shares
    among themselves.  Without ``total`` it is the largest size at which every
    source can hold its share; with a larger one, what a source cannot give is
    left out and shows in the report.
    """
    of = {s: n for s, n in sizes.items() if n and n > 0 and s in targets and targets[s][0] > 0 and targets[s][1] > 0}
    if not of:
        return Plan(0.0, {}, {})
    share = sum(targets[s][0] for s in of)
    most = {s: targets[s][1] * n for s, n in of.items()}
    size = min(most[s] * share / targets[s][0] for s in of) if total is None else total
    return Plan(size, {s: min(float(most[s]), size * targets[s][0] / share) for s in of}, {s: targets[s][1] for s in of})


def _scales(rows: DataFrame, due: Plan) -> dict[str, float]:
    """For each source the c with which its documents, each used min(most, c * weight) times, have the tokens due.

    The size is a rising and concave function of c, so steps along its slope
    from below never pass the solution.  Each step is an aggregation by source.
    """
    spark = rows.sparkSession
    scale = dict.fromkeys(due.tokens, 0.0)
    for _ in range(CORRECTIONS):
        at = spark.createDataFrame([(s, c, due.most[s]) for s, c in scale.items()], "s string, c double, most int")
        below = F.col("c") * F.col("w") < F.col("most")
        used = F.least(F.col("most").cast("double"), F.col("c") * F.col("w"))
        sums = rows.join(F.broadcast(at), "s").groupBy("s").agg(F.sum(F.col("n") * used).alias("now"), F.sum(F.when(below, F.col("n") * F.col("w")).otherwise(0.0)).alias("slope"))
        missing = {r["s"]: (due.tokens[r["s"]] - r["now"], r["slope"]) for r in sums.collect()}  # one row for each listed source
        if all(gap <= EXACT * due.tokens[s] or slope == 0 for s, (gap, slope) in missing.items()):
            break
        scale |= {s: scale[s] + gap / slope for s, (gap, slope) in missing.items() if slope > 0 and gap > 0}
    return scale


def mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str,
    source: str,
    size: str,
    total: float | None = None,
    weight: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """(key, source, size, copies) of the documents of the mixture.

    ``docs`` has one row per document with its size in tokens; it is read
    several times, so give something that is cheap to read.  ``targets`` has
    (source, target_share, max_repeats).  Sources are compared lower-cased and
    trimmed.  Documents without a source, of a source that is not listed, or of
    size null or 0 take no part.  The choice depends on ``seed`` and the key
    only; ties are broken by key.  Repeated keys are drawn alike.

    No group is collected: sizes are added up by source and bucket of rank, and
    only the bucket in which a source's size is reached is gone through in
    order.  There, documents that don't fit any more are passed over, so a
    source misses its size by less than its smallest document that is left.
    """
    spark = docs.sparkSession
    name = F.lower(F.trim(F.col(source)))
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = docs.select(F.col(key).alias("k"), name.alias("s"), F.col(size).cast("long").alias("n"), w.alias("w")).filter("k is not null and s is not null and n > 0 and w > 0")
    listed = targets.select(F.lower(F.trim(F.col("source"))).alias("s"), "target_share", "max_repeats").filter("s is not null")
    wanted = {r["s"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in listed.limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    sums = rows.join(listed.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    due = plan({r["s"]: r["n"] for r in sums}, wanted, total)
    whole = {r["s"]: r["n"] for r in sums}
    scale = {s: t / whole[s] for s, t in due.tokens.items()} if weight is None else _scales(rows, due)
    held = [(r["s"], scale[r["s"]], due.most[r["s"]], max(1, r["docs"] // PER_BUCKET)) for r in sums if r["s"] in due.tokens]
    steps = spark.createDataFrame(held, "s string, c double, most int, buckets long")
    u = (F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    part = F.col("due") - F.floor("due")
    chance = F.when(part > 1e-9, part).otherwise(0.0)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    drawn = (
        rows.join(F.broadcast(steps), "s")  # one row for each listed source
        .withColumn("due", F.least(F.col("most").cast("double"), F.col("c") * F.col("w")))
        .withColumns({"whole": F.floor("due"), "chance": chance})
        .withColumn("rank", F.when(F.col("chance") > 0, odds))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")))
    )
    by_bucket = drawn.groupBy("s", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("whole")).alias("certain"))
    order = Window.partitionBy("s").orderBy(F.col("bucket").asc_nulls_first())
    running = by_bucket.withColumns(
        {
            "before": F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "all_certain": F.sum("certain").over(Window.partitionBy("s")),
        }
    ).withColumn("before", F.coalesce("before", F.lit(0)))
    tokens = spark.createDataFrame(list(due.tokens.items()), "s string, tokens double")
    rest = F.greatest(F.lit(0.0), F.col("tokens") - F.col("all_certain"))
    # one row for each listed source: the bucket where its size is reached
    cuts = (
        running.join(F.broadcast(tokens), "s")
        .withColumn("rest", rest)
        .filter("bucket is not null and before < rest")
        .groupBy("s")
        .agg(F.max(F.struct("bucket", "before", "rest")).alias("c"))
        .select("s", F.col("c.bucket").alias("cut"), (F.col("c.rest") - F.col("c.before")).alias("room"))
    )
    at = drawn.join(F.broadcast(cuts), "s", "left")
    sure = at.filter("bucket is null or cut is null or bucket != cut").withColumn("extra", F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0))
    edge = at.filter("bucket = cut").select("s", "rank", "k", "n", "whole", "room")
    kept = T.StructType([edge.schema[c] for c in ("s", "k", "n", "whole")] + [T.StructField("extra", T.IntegerType())])
    edge = fold_sorted(edge, ["s"], ["rank", "k"], _taken, kept)
    return (
        sure.select("s", "k", "n", "whole", "extra")
        .unionByName(edge)
        .select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias(size), (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
        .filter("copies > 0")
    )


def _taken(source: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One more copy for the documents of one bucket that fit, in the order of their ranks."""
    room = None
    for _, k, n, whole, at_first in rows:
        room = at_first if room is None else room
        fits = n <= room
        room -= n * fits
        yield *source, k, n, whole, int(fits)


def shares(mixed: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Target, due and actual share of each listed source, with documents, copies and tokens.

    The share due is the target among the listed sources that occur in the
    mixture, and null for the others.
    """
    got = mixed.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("documents"),
        F.sum("copies").alias("copies"),
        F.max("copies").cast("int").alias("most_copies"),
        F.sum(F.col("copies") * F.col(size)).alias("tokens"),
    )
    zero = {c: 0 for c in ("documents", "copies", "most_copies", "tokens")}
    report = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")
    whole = report.agg(F.sum("tokens").alias("total"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("all_due"))
    due = F.when(F.col("tokens") > 0, F.col("target_share") / F.col("all_due"))
    return (
        report.crossJoin(whole)  # one row
        .withColumn("due_share", due)
        .na.fill(zero)
        .select("source", "target_share", "due_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), "max_repeats", *zero)
    )
