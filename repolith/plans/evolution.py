"""Evolution summaries and monthly signals of working copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.time import instant, month_key
from repolith.operators import activity
from repolith.rules import words


def commits_of(log: DataFrame) -> DataFrame:
    """One row per commit of a log with a row per touched file."""
    return log.groupBy("repo", "ord", "sha", "author", "email", "at", "subject").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("path").alias("files"))


def evolution(log: DataFrame, top: int = words.TOP_FILES) -> DataFrame:
    """(repo, total, trend, top_files, authors, hotspots), each list in its order."""
    commits = commits_of(log)
    total = commits.groupBy("repo").agg(F.count("*").alias("total"))

    def listed(df: DataFrame, name: str, order: list, fields: list[str]) -> DataFrame:
        key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*fields).alias("v"))
        return df.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["v"]).alias(name))

    trend = activity.weekly_trend(commits, instant("at"), F.col("added"), F.col("removed"), ["repo"])
    churn = activity.file_churn(log.filter("path is not null"), "path", "sha", "added", "removed", "ord", ["repo"])
    best = activity.top_files(churn, top, ["repo"])
    names = activity.authors(commits, "author", F.col("added"), F.col("ord"), ["repo"])
    hot = activity.hotspots(best, total, ["repo"])
    evidence = F.array(
        F.format_string("commits: %d", "commits"), F.format_string("added: %d", "added"), F.format_string("removed: %d", "removed"), F.format_string("share: %d%%", F.bround(100 * F.col("share"), 0).cast("long"))
    )
    made = total
    for part in (
        listed(trend, "trend", [F.col("week")], ["week", "commits", "added", "removed"]),
        listed(best, "top_files", [F.col("place")], ["path", "commits", "added", "removed"]),
        listed(names, "authors", [-F.col("commits"), F.col("first")], ["author", "commits", "added"]),
        listed(hot.withColumn("evidence", evidence), "hotspots", [F.col("place")], ["path", "level", "evidence"]),
    ):
        made = made.join(part, "repo", "left")
    return made


def git_facts(log: DataFrame) -> DataFrame:
    """First and last date, commits, contributors and commits by month of each working copy's history."""
    return activity.summary(commits_of(log), ["repo"], "at", "email")


def signals(log: DataFrame, manifests: DataFrame, months: int | None = None, most: int = words.MAX_COMMITS) -> DataFrame:
    """(repo, month, commits, contributors, new_dirs, deps_added, top_terms, truncated): the oldest ``most`` commits by month."""
    commits = commits_of(log)
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ord")))
    kept = commits.withColumn("age", age).withColumn("truncated", F.max("age").over(Window.partitionBy("repo")) > most).filter(F.col("age") <= most)
    slices = activity.month_slices(kept, ["repo"], "at", "email", "subject", "age")
    top = F.substring_index("path", "/", 1)
    dirs = log.filter("path like '%/%'").withColumn("dir", top).filter("dir not like '.%'").join(kept.select("repo", "sha"), ["repo", "sha"], "left_semi")
    first = dirs.groupBy("repo", "dir").agg(F.max_by("at", "ord").alias("at"))  # the greatest ordinal is the oldest commit
    new = first.groupBy("repo", month_key("at").alias("month")).agg(F.sort_array(F.collect_list("dir")).alias("new_dirs"))
    deps = activity.added_since(manifests, ["repo"], "month", "names").select("repo", "month", F.col("added").alias("deps_added"))
    cut = kept.groupBy("repo").agg(F.max("truncated").alias("truncated"))
    empty = F.array().cast("array<string>")
    made = slices.join(new, ["repo", "month"], "left").join(deps, ["repo", "month"], "left").join(cut, "repo")
    made = made.withColumns({c: F.coalesce(c, empty) for c in ("new_dirs", "deps_added")})
    return activity.last_months(made, ["repo"], "month", months) if months else made
