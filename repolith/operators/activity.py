"""Statistics of a commit history: trends, churn, authors, hotspots, monthly slices.

Every function takes and gives DataFrames.  Commits are (sha, at, author, ...)
with one row per commit; ties are broken by a total order, never by the order
in which rows happen to come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.time import month_key, week_start
from repolith.rules import words


def summary(commits: DataFrame, by: list[str], date: str, author: str) -> DataFrame:
    """First and last date, commits, distinct authors and a map of commits by month."""
    month = commits.groupBy(*by, month_key(date).alias("month")).agg(F.count("*").alias("n"))
    activity = month.filter("month is not null").groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n")))).alias("activity_by_month"))
    whole = commits.groupBy(*by).agg(
        F.min(date).alias("first_commit_at"), F.max(date).alias("last_commit_at"), F.count("*").alias("commit_count"), F.count_distinct(author).alias("contributor_count")
    )
    return whole.join(activity, by, "left") if by else whole.crossJoin(activity)


def weekly_trend(commits: DataFrame, at: Column, added: Column, removed: Column, by: list[str] | None = None) -> DataFrame:
    """Commits and changed lines by week (ISO Monday, UTC); commits without an instant have the week ''."""
    return commits.groupBy(*(by or []), week_start(at).alias("week")).agg(
        F.count("*").alias("commits"), F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum(removed), F.lit(0)).alias("removed")
    )


def file_churn(touches: DataFrame, path: str, commit: str, added: str, removed: str, ord_: str, by: list[str] | None = None) -> DataFrame:
    """Commits and lines by file; ``first`` is the least ordinal at which it was met."""
    return touches.groupBy(*(by or []), F.col(path).alias("path")).agg(
        F.count_distinct(commit).alias("commits"), F.sum(added).alias("added"), F.sum(removed).alias("removed"), F.min(ord_).alias("first")
    )


def top_files(churn: DataFrame, n: int = words.TOP_FILES, by: list[str] | None = None) -> DataFrame:
    """The n most changed files of all, or of each group with their ``place``: commits, then added lines, then first met (a report)."""
    order = [F.desc("commits"), F.desc("added"), F.asc("first"), F.asc("path")]
    if not by:
        return churn.orderBy(*order).limit(n)
    return churn.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def hotspots(top: DataFrame, total: DataFrame, by: list[str] | None = None) -> DataFrame:
    """HIGH and MEDIUM files among the most changed ones; ``total`` has the number of commits, in one row or in one for each group."""
    share = F.col("commits") / F.greatest(F.col("total"), F.lit(1))
    high = (share >= words.HOT_SHARE) & (F.col("added") >= words.HOT_ADDED_WITH_SHARE) | (F.col("added") >= words.HOT_ADDED)
    level = F.when(high, "HIGH").when(F.col("commits") >= words.HOT_COMMITS, "MEDIUM")
    met = top.join(total, by) if by else top.crossJoin(total)  # total is one row
    return met.withColumns({"share": share, "level": level}).filter("level is not null")


def authors(commits: DataFrame, name: str, added: Column, ord_: Column, by: list[str] | None = None) -> DataFrame:
    """Commits and added lines by name, and when it was met first; null and empty names are 'unknown'."""
    return commits.groupBy(*(by or []), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")).alias("author")).agg(
        F.count("*").alias("commits"), F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.min(ord_).alias("first")
    )


def terms_of(text: Column, pattern: str = words.SUBJECT_TERM, stop: list[str] | None = None) -> Column:
    """Terms of a text in order, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(words.SUBJECT_STOPWORDS if stop is None else stop))


def top_terms(terms: DataFrame, by: list[str], n: int = words.TOP_TERMS) -> DataFrame:
    """The n most frequent terms of each group in order, from rows (by, term, ord).

    Counting has a partial step, so a group's terms are gathered as counts only.
    """
    counted = terms.groupBy(*by, "term").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("first"), F.asc("term")))
    return counted.withColumn("place", place).filter(F.col("place") <= n).select(*by, "place", "term", "n")


def month_slices(commits: DataFrame, by: list[str], date: str, author: str, subject: str, ord_: str) -> DataFrame:
    """Commits, distinct authors (null is 'unknown') and top terms of each month."""
    rows = commits.withColumn("month", month_key(date)).filter("month is not null")
    counts = rows.groupBy(*by, "month").agg(F.count("*").alias("commits"), F.count_distinct(F.coalesce(author, F.lit("unknown"))).alias("contributors"))
    exploded = rows.select(*by, "month", F.col(ord_).alias("o"), F.posexplode(terms_of(F.col(subject))).alias("p", "term"))
    top = top_terms(exploded.withColumn("ord", F.struct("o", "p")), [*by, "month"])
    lists = top.groupBy(*by, "month").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("top_terms"))
    return counts.join(lists, [*by, "month"], "left").withColumn("top_terms", F.coalesce("top_terms", F.array().cast("array<string>")))


def first_seen(items: DataFrame, by: list[str], item: str, when: str) -> DataFrame:
    """When each item of a group was met first."""
    return items.groupBy(*by, item).agg(F.min(when).alias("first_month"))


def month_ends(rows: DataFrame, by: list[str], month: str, ord_: list[str]) -> DataFrame:
    """The rows after which the month changes, and the last one, of groups in the order of ``ord_``.

    The months must rise with the order, as beginnings of its first column do;
    then these are the last rows of the months, which an aggregation finds
    without bringing a group's rows together.  Rows without a month have their
    last row too.
    """
    rest = [c for c in rows.columns if c not in (*by, month)]
    last = rows.groupBy(*by, month).agg(F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(ord_)), *rest)).alias("_r"))
    return last.select(*by, month, *(F.col("_r")[c].alias(c) for c in rest))


def added_since(rows: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """Items of each row's set that the row before did not have; the first is compared with the empty set."""
    before = F.lag(items).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("added", F.sort_array(F.array_except(items, F.coalesce(before, F.array().cast("array<string>")))))


def last_months(rows: DataFrame, by: list[str], month: str, n: int) -> DataFrame:
    """Rows of the last n months of each group."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(month)))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
