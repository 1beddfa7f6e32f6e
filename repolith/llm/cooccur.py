"""How often items appear together, and how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.storage import materialize

#: Baskets with more items are large: they are cut into blocks, and emit fewer pairs where a pair must meet more than once.
LARGE = 2000


def cooccurrence(
    df: DataFrame,
    basket: str,
    item: str,
    min_count: int = 1,
    min_lift: float | None = None,
    large: int = LARGE,
) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, lift, pmi) of items a < b (by bytes) in at least ``min_count`` baskets together.

    An item counts once per basket.  The number of baskets n is that of all
    distinct values of ``basket``, also of those without items.  lift is
    n_ab * n / (n_a * n_b), pmi its natural logarithm.  Null baskets and items
    are left out; empty text is an item like any other.  No rows give no pairs.

    Items are deduplicated in each basket and numbered, each basket emits its
    ordered pairs of numbers, and counts are combined before the shuffle.  Items
    that cannot be in a result are dropped before: those in fewer than
    ``min_count`` baskets, and with ``min_lift`` those in more than n / min_lift.
    Both bounds are exact.

    A basket of more than ``large`` remaining items is cut into blocks of about
    so many, and a task emits the pairs of two blocks.  And a pair of items that
    meets ``min_count`` times meets in a basket other than the min_count - 1
    largest ones of either item; so these, where they are large, emit no pairs
    with the item, and are counted for the pairs found elsewhere.  Baskets that
    hold a good part of all items thereby cost a lookup for each pair and not
    the square of their size.  Counts are exact, and no number of baskets, large
    ones or items is too high.
    """
    baskets = df.filter(F.col(basket).isNotNull()).agg(F.count_distinct(basket)).first()[0]
    base = df.select(F.col(basket).alias("k"), F.col(item).alias("i")).filter("k is not null and i is not null").distinct()
    able = base.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    if min_lift:
        able = able.filter(F.col("n") * min_lift <= baskets)
    able = materialize(able.withColumn("id", F.monotonically_increasing_id()), "items")
    kept = materialize(base.join(able.select("i", "id"), "i").select("k", "id"), "baskets")
    big = kept.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > large)
    some_big = not big.isEmpty()
    if some_big:
        pairs = _with_large(kept, materialize(big, "large"), min_count, large)
    else:
        pairs = _emitted(kept.groupBy("k").agg(F.collect_list("id").alias("ids")))
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    n = F.lit(float(baskets))
    first, second = F.col("ia") < F.col("ib"), F.col("ia") >= F.col("ib")
    return (
        pairs.join(able.select(F.col("id").alias("a"), F.col("i").alias("ia"), F.col("n").alias("na")), "a")
        .join(able.select(F.col("id").alias("b"), F.col("i").alias("ib"), F.col("n").alias("nb")), "b")
        .withColumn("lift", F.col("n_ab") * n / (F.col("na") * F.col("nb")))
        .filter(F.lit(True) if min_lift is None else F.col("n_ab") * n >= min_lift * F.col("na") * F.col("nb"))
        .select(
            F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "n_ab",
            F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n_a"), F.when(second, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
            "lift", F.log("lift").alias("pmi"),
        )
    )


def _emitted(blocks: DataFrame) -> DataFrame:
    """(a, b, c): the pairs a < b within each array ``ids``, counted before they are shuffled."""
    return (
        blocks.select(F.sort_array("ids").alias("ids"))
        .select("ids", F.posexplode("ids").alias("p", "a"))
        .select("a", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"))
    )


def _with_large(kept: DataFrame, big: DataFrame, min_count: int, large: int) -> DataFrame:
    """(a, b, c) whose sums are the counts of the pairs that can reach ``min_count``; ``big`` has (k, size) of the large baskets."""
    sized = kept.join(big, "k", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "k"))
    # At most min_count - 1 rows of an item are kept by every task before the shuffle.
    set_aside = materialize(sized.filter("size is not null").withColumn("rank", rank).filter(F.col("rank") < min_count).select("k", "id"), "aside")
    emitting = sized.join(set_aside, ["k", "id"], "left_anti")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / large)
    blocks = emitting.groupBy("k", F.pmod(F.xxhash64("id"), parts).alias("block")).agg(F.collect_list("id").alias("ids"), F.max("size").alias("size"))
    blocks = materialize(blocks, "blocks")
    cut = blocks.filter("size is not null")
    across = (
        cut.select("k", "block", F.col("ids").alias("x"))
        .join(cut.select("k", F.col("block").alias("other"), F.col("ids").alias("y")), "k")
        .filter("block < other")
        .select(F.explode("x").alias("x"), "y")
        .select("x", F.explode("y").alias("y"))
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.count("*").alias("c"))
    )
    met = _emitted(blocks).unionByName(across)
    if min_count < 2:
        return met
    met = materialize(met.groupBy("a", "b").agg(F.sum("c").alias("c")), "met")
    pairs = met.select("a", "b")
    of_a = pairs.join(set_aside.withColumnRenamed("id", "a"), "a").join(kept.withColumnRenamed("id", "b"), ["k", "b"]).select("a", "b")
    of_b = pairs.join(set_aside.withColumnRenamed("id", "b"), "b").join(kept.withColumnRenamed("id", "a"), ["k", "a"])
    of_b = of_b.join(set_aside.withColumnRenamed("id", "a"), ["k", "a"], "left_anti").select("a", "b")
    aside = of_a.unionByName(of_b).groupBy("a", "b").agg(F.count("*").alias("c"))
    return met.unionByName(aside)
