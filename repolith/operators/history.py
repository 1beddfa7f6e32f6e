"""History of changing attributes: a bitemporal ledger.

A snapshot says "from this instant (valid time) the entity looked like this",
and it reached us at some other instant (recorded time).  Snapshots may arrive
late, twice or in conflict.  The ledger keeps, for every belief we ever held,
the valid period and the recorded period; a late snapshot splits the period
that it falls into and supersedes the row, whose recorded period is closed.
Nothing is overwritten: the history as known at any earlier time can be read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.operators.fold import fold_sorted
from repolith.operators.ordered import neighbour
from repolith.storage import materialize

#: Most snapshots of one entity that a single task sweeps; beyond it, an entity's
#: valid time is cut into ranges.
ROWS_PER_SWEEP = 200_000
#: Cuts of valid time that the sketch of an entity gives; it has at most so many ranges.
QUANTILES = 1024


def sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Sweep one entity's snapshots along recorded time.

    ``rows``: (valid, recorded, attributes, is_head) in recorded order.  A head
    is the earliest valid time now known in a later range of the same entity;
    it only bounds the last open period.  Gives (attributes, valid_from,
    valid_to, recorded_from, recorded_to); open ends are None.
    """
    known: list = []  # valid times in order
    held: dict = {}  # valid time -> [attributes, valid_to, recorded_from]
    head = None

    def supersede(v, now, until) -> Iterator[tuple]:
        state, to, since = held[v]
        if since != now:
            yield state, v, to, since, now
        held[v] = [state, until, now]

    for valid, recorded, state, is_head in rows:
        if is_head:
            if head is None or valid < head:
                head = valid
                if known:
                    yield from supersede(known[-1], recorded, head)
        elif valid in held:
            old, to, since = held[valid]
            if old != state:
                if since != recorded:
                    yield old, valid, to, since, recorded
                held[valid] = [state, to, recorded]
        else:
            i = bisect_left(known, valid)
            until = known[i] if i < len(known) else head
            if i:
                yield from supersede(known[i - 1], recorded, valid)
            known.insert(i, valid)
            held[valid] = [state, until, recorded]
    for v in known:
        state, to, since = held[v]
        yield state, v, to, since, None


def _ranges(events: DataFrame, hot: DataFrame, rows_per_sweep: int) -> DataFrame:
    """Number the valid-time range of each event; only the entities in ``hot`` (key, n) have more than one.

    The cuts of a hot entity are quantiles from a mergeable sketch over its own
    rows, so no task ever holds an entity's rows to find them.  The sketch gives
    ``QUANTILES`` cuts whatever the size of the table; an entity takes every
    so-manieth of them, as its own size asks for.
    """
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    parts = F.least(F.ceil(F.col("n") / rows_per_sweep), F.lit(QUANTILES))
    every = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) / parts))
    found = (
        events.join(hot, "key")
        .groupBy("key")
        .agg(F.max("n").alias("n"), F.percentile_approx(F.unix_micros("valid"), cuts, F.lit(4 * QUANTILES)).alias("cuts"))
        .withColumn("every", every)
        .select("key", F.expr("array_distinct(filter(cuts, (c, i) -> (i + 1) % every = 0))").alias("cuts"))
    )
    at = F.unix_micros("valid")
    return events.join(found, "key", "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c <= at)), F.lit(0))).drop("cuts")


def ledger(
    df: DataFrame,
    key: str,
    valid: Column,
    recorded: Column,
    attributes: dict[str, Column],
    rows_per_sweep: int = ROWS_PER_SWEEP,
) -> DataFrame:
    """Every belief about every entity, with valid and recorded periods.

    Gives (key, <attributes>, valid_from, valid_to, recorded_from, recorded_to,
    range); periods are half-open, an open end is null.  Rules: rows without a
    key or a valid time have no place in a history and are left out; an unknown
    recorded time counts as the earliest; of rows with one key, valid and
    recorded time the one with the greatest attributes (nulls least, in their
    order) counts; a row that says again what is already held changes nothing.
    An empty input gives an empty ledger.  Other columns, whatever their names,
    are not read.

    Cost: a count by entity, one aggregation, one shuffle and sort on the entity,
    one pass.  Entities with more than ``rows_per_sweep`` rows are swept in ranges of valid
    time, in parallel; the first instants of later ranges travel to the earlier
    ones as heads.
    """
    events = (
        df.select(
            F.col(key).alias("key"),
            valid.alias("valid"),
            F.coalesce(recorded, F.lit("1000-01-01T00:00:00Z").cast("timestamp")).alias("recorded"),
            F.struct(*(c.alias(n) for n, c in attributes.items())).alias("state"),
        )
        .filter("key is not null and valid is not null")
        .groupBy("key", "valid", "recorded")
        .agg(F.max("state").alias("state"))
    )
    kinds = dict((f.name, f.dataType) for f in events.schema)
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    hot = materialize(counts.filter(F.col("n") > rows_per_sweep), "hot")
    if not hot.isEmpty():
        events = _ranges(events, hot, rows_per_sweep)
        before = Window.partitionBy("key", "range").orderBy("recorded", "valid").rowsBetween(Window.unboundedPreceding, -1)
        least = F.min("valid").over(before)
        heads = (
            events.filter("range > 0")
            .withColumn("least", least)
            .filter("least is null or valid < least")
            .select("key", "valid", "recorded", F.explode(F.sequence(F.lit(0), F.col("range") - 1)).alias("range"))
        )
        swept = events.withColumn("is_head", F.lit(False)).unionByName(heads.withColumn("is_head", F.lit(True)), allowMissingColumns=True)
    else:
        swept = events.withColumns({"range": F.lit(0), "is_head": F.lit(False)})
    swept = swept.select("key", "range", "valid", "recorded", "state", "is_head")
    time = T.TimestampType()
    schema = T.StructType(
        [T.StructField("key", kinds["key"]), T.StructField("range", T.IntegerType()), T.StructField("state", kinds["state"])]
        + [T.StructField(n, time) for n in ("valid_from", "valid_to", "recorded_from", "recorded_to")]
    )

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        return (k + made for made in sweep(rows))

    made = fold_sorted(swept, ["key", "range"], ["recorded", "valid", "is_head"], fold, schema)
    return made.select(F.col("key").alias(key), "state.*", "valid_from", "valid_to", "recorded_from", "recorded_to", "range")


def as_known(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """The ledger's rows believed at ``at``; without it, those believed now."""
    if at is None:
        return rows.filter(F.col("recorded_to").isNull())
    return rows.filter((F.col("recorded_from") <= at) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > at)))


def versions(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Join neighbouring periods with equal attributes into versions.

    ``rows`` are ledger rows believed at one time.  Gives (key, <attributes>,
    valid_from, valid_to).  Null equals null.
    """
    kept = materialize(rows.select(key, "range", "valid_from", F.struct(*attributes).alias("state")), "periods")  # read twice
    near = neighbour(kept, key, "valid_from", F.col("state"), "before")
    starts = near.filter(~F.col("before_exists") | ~F.col("before").eqNullSafe(F.col("state"))).select(key, "range", "valid_from", "state")
    ends = neighbour(starts, key, "valid_from", F.col("valid_from"), "valid_to", ahead=True)
    return ends.select(key, "state.*", "valid_from", "valid_to")
