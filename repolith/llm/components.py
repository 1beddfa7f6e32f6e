"""Connected components by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.storage import materialize

#: Rounds after which something must be wrong: each at least halves the depth.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b): the least node that can be reached.

    Edges with a null end are left out; an edge from a node to itself makes it a
    component.  Each step passes once over the neighbours of each node in their
    order, of which the first is the least: one exchange, and no gathering in
    memory, as a window spills; a node of very many neighbours is one task's.
    Each round is written to the shared folder.
    """
    nodes = edges.filter("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    mark = None
    least = F.min("v").over(Window.partitionBy("u").orderBy("v"))
    for _ in range(MOST_ROUNDS):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = (
            large.withColumn("m", least)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u != v")
            .distinct()
        )
        new = materialize(small, "star")
        # equal sets have equal marks; only where these agree are the edges compared
        made = tuple(new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        same = made == mark and new.join(now, ["u", "v"], "left_anti").isEmpty()
        now, mark = new, made
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
