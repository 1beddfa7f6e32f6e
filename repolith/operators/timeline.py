"""Stages of a project's history from monthly slices.

Neighbouring months are compared by weighted cosine; a stage begins at a
calendar gap or where months differ.  Boundaries are window expressions; the
two merges, whose decisions depend on merged neighbours, are ordered folds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.functions.time import month_index
from repolith.operators.fold import fold_sorted
from repolith.rules import words

#: (month, commits, contributors, new_dirs, deps_added, top_terms) of one repository's months.
BUCKET = ["month", "commits", "contributors", "new_dirs", "deps_added", "top_terms"]


def merge_sparse(months: DataFrame, repo: str, least: int = words.MIN_BUCKET_COMMITS, span: int = words.MAX_MERGE_SPAN) -> DataFrame:
    """Buckets: months with fewer than ``least`` commits join the bucket before.

    That is, if the bucket's own month is no more than ``span`` months before;
    otherwise they stand alone.  Months without commits are dropped.  Commits
    add up, contributors are the maximum, lists are united in order.
    """
    kinds = {f.name: f.dataType for f in months.schema}
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField(repo, kinds[repo]), T.StructField("month", T.StringType()), T.StructField("commits", T.LongType()), T.StructField("contributors", T.LongType())]
        + [T.StructField(c, strings) for c in BUCKET[3:]]
        + [T.StructField("merged", strings)]
    )

    def index(month: str) -> int:
        return int(month[:4]) * 12 + int(month[5:7]) - 1

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list | None = None
        for month, commits, contributors, *lists in rows:
            if not commits:
                continue
            lists = [list(x or []) for x in lists]
            if held and commits < least and index(month) - index(held[0]) <= span:
                held[1] += commits
                held[2] = max(held[2], contributors or 0)
                for i, x in enumerate(lists, 3):
                    held[i] += [v for v in dict.fromkeys(x) if v not in held[i]]
                held[6].append(month)
                continue
            if held:
                yield (*key, *held)
            held = [month, commits, contributors or 0, *lists, []]
        if held:
            yield (*key, *held)

    ok = months.filter(month_index(F.col("month")).isNotNull() & F.col(repo).isNotNull()).select(repo, *BUCKET)
    return fold_sorted(ok, [repo], ["month"], fold, schema)


def similarity(buckets: DataFrame, repo: str) -> DataFrame:
    """(repo, month, gap, cosine): each bucket against the one before.

    ``gap`` is true where more than a month lies between; the first bucket has
    neither.  The weighted features are sets, so the cosine comes from array
    functions on two neighbouring rows, without a join.
    """
    order = Window.partitionBy(repo).orderBy("month")
    kinds = [("dir", "new_dirs"), ("dep", "deps_added"), ("term", "top_terms")]
    empty = F.array().cast("array<string>")
    sets = buckets.select(repo, "month", *(F.array_distinct(F.coalesce(c, empty)).alias(k) for k, c in kinds))
    near = sets.withColumns({f"before_{k}": F.lag(k).over(order) for k, _ in kinds} | {"before": F.lag("month").over(order)})

    def square(name: str) -> Column:
        return sum((F.size(F.col(f"{name}{k}")) * words.FEATURE_WEIGHTS[k] ** 2 for k, _ in kinds), F.lit(0.0))

    dot = sum((F.size(F.array_intersect(k, f"before_{k}")) * words.FEATURE_WEIGHTS[k] ** 2 for k, _ in kinds), F.lit(0.0))
    norm = F.sqrt(square("") * square("before_"))
    return near.select(
        repo,
        "month",
        (month_index(F.col("month")) - month_index(F.col("before")) > 1).alias("gap"),
        F.when(F.col("before").isNotNull(), F.when(norm > 0, dot / norm).otherwise(0.0)).alias("cosine"),
    )


def stages(near: DataFrame, repo: str, theta: float = words.THETA) -> DataFrame:
    """(repo, month, stage): the number of the stage each bucket is in, from 0."""
    cut = F.col("cosine").isNull() | F.coalesce("gap", F.lit(False)) | (F.col("cosine") < theta)
    order = Window.partitionBy(repo).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("stage", (F.sum(cut.cast("int")).over(order) - 1).cast("int")).select(repo, "month", "stage")


def merge_small(staged: DataFrame, repo: str, least: int = words.MIN_STAGE_BUCKETS) -> DataFrame:
    """(repo, stage, new_stage): stages of fewer than ``least`` buckets fold into the merged stage before; the first never does."""
    sizes = staged.groupBy(repo, "stage").agg(F.count("*").alias("n"))
    order = Window.partitionBy(repo).orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    keeps = (F.col("stage") == 0) | (F.col("n") >= least)
    return sizes.withColumn("new_stage", (F.sum(keeps.cast("int")).over(order) - 1).cast("int")).select(repo, "stage", "new_stage")


def stage_stats(buckets: DataFrame, staged: DataFrame, repo: str) -> DataFrame:
    """One row per stage: first and last month, months, commits, contributors, directories, dependencies, terms."""
    joined = buckets.join(staged, [repo, "month"])

    def united(c: str) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))

    return joined.groupBy(repo, "stage").agg(
        F.min("month").alias("start_month"),
        F.max("month").alias("end_month"),
        F.count("*").alias("months"),
        F.sum("commits").alias("commits"),
        F.max("contributors").alias("max_contributors"),
        united("new_dirs").alias("dirs"),
        united("deps_added").alias("deps"),
        F.slice(united("top_terms"), 1, words.STAGE_TERMS).alias("terms"),
    )
