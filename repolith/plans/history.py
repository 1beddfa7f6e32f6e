"""Queries over commit histories, monthly signals and churn, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.time import instant, month_key
from repolith.operators import activity, timeline
from repolith.rules import words
from repolith.session import pin
from repolith.storage import table


def commits_of(spark: SparkSession, d: str) -> DataFrame:
    """One row per (repo_id, sha): of several deliveries the greatest in all fields."""
    fields = ["authored_at", "author_email", "message", "additions", "deletions", "files_changed", "is_my_commit"]
    rows = table(pin(spark), d, "commits").filter("repo_id is not null and sha is not null")
    return rows.groupBy("repo_id", "sha").agg(F.max(F.struct(*fields)).alias("c")).select("repo_id", "sha", "c.*")


def months_of(spark: SparkSession, d: str) -> DataFrame:
    return table(pin(spark), d, "signal_months")


def touches_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as files touched by commits: (commit, path, added, removed, at)."""
    lines = table(pin(spark), d, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("commit"),
        F.concat(F.lit("file-"), F.col("l_suppkey").cast("string")).alias("path"),
        F.col("l_quantity").cast("long").alias("added"),
        F.col("l_linenumber").cast("long").alias("removed"),
    )


def commit_summary(spark, d):
    made = activity.summary(commits_of(spark, d), ["repo_id"], "authored_at", "author_email")
    shown = F.array_join(F.transform(F.map_entries("activity_by_month"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return made.withColumn("activity_by_month", shown)


def weekly_trend(spark, d):
    return activity.weekly_trend(commits_of(spark, d), instant("authored_at"), F.col("additions"), F.col("deletions"))


def churn(spark, d):
    return activity.file_churn(touches_of(spark, d), "path", "commit", "added", "removed", "commit")


def file_churn_top(spark, d):
    return activity.top_files(churn(spark, d))


def hotspots(spark, d):
    total = table(spark, d, "orders").agg(F.count("*").alias("total"))
    made = activity.hotspots(activity.top_files(churn(spark, d)), total)
    return made.select("path", "commits", "added", "level", F.bround(100 * F.col("share"), 0).cast("long").alias("share_pct"))


def authors(spark, d):
    log = table(pin(spark), d, "gitlog").distinct()
    made = activity.authors(log, "authorName", F.col("linesAdded"), F.negate(F.unix_micros(instant("committedAt"))))
    return made.select(F.row_number().over(Window.orderBy(F.desc("commits"), "first", "author")).alias("place"), "author", "commits", "added")  # one row for each name


def month_slices(spark, d):
    made = activity.month_slices(commits_of(spark, d), ["repo_id"], "authored_at", "author_email", "message", "sha")
    return made.select("repo_id", "month", "commits", "contributors", F.array_join("top_terms", " ").alias("top_terms"))


def month_terms(spark, d):
    rows = commits_of(spark, d).withColumn("month", month_key("authored_at"))
    terms = rows.select("month", F.col("sha").alias("o"), F.posexplode(activity.terms_of(F.col("message"))).alias("p", "term"))
    return activity.top_terms(terms.withColumn("ord", F.struct("o", "p")), ["month"])


def first_seen(spark, d):
    dirs = months_of(spark, d).select("repo", "month", F.explode("new_dirs").alias("dir"))
    return activity.first_seen(dirs, ["repo"], "dir", "month")


def month_end_lead(spark, d):
    rows = commits_of(spark, d).select("repo_id", "sha", "authored_at", month_key("authored_at").alias("month"))
    return activity.month_ends(rows, ["repo_id"], "month", ["authored_at", "sha"]).select("repo_id", "month", "sha")  # texts, so months rise with them


def new_per_month(spark, d):
    one = months_of(spark, d).groupBy("repo", "month").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("top_terms")))).alias("terms"))
    return activity.added_since(one, ["repo"], "month", "terms").select("repo", "month", F.array_join("added", " ").alias("added"))


def last_n_months(spark, d):
    return activity.last_months(months_of(spark, d).select("repo", "month", "commits", "contributors").distinct(), ["repo"], "month", 3)


def buckets_of(spark, d):
    """One row per repository and month, lists in order; of repeated rows the greatest."""
    rows = months_of(spark, d).filter("repo is not null and month is not null")
    return rows.groupBy("repo", "month").agg(F.max(F.struct(*timeline.BUCKET[1:])).alias("b")).select("repo", "month", "b.*")


def month_gaps(spark, d):
    near = timeline.similarity(buckets_of(spark, d), "repo")
    return near.filter("gap").select("repo", "month")


def neighbor_cosine(spark, d):
    near = timeline.similarity(buckets_of(spark, d), "repo")
    return near.select("repo", "month", F.bround("cosine", 6).alias("cosine"))


def stage_ids(spark, d):
    return timeline.stages(timeline.similarity(buckets_of(spark, d), "repo"), "repo")


def stage_stats(spark, d):
    buckets = buckets_of(spark, d)
    made = timeline.stage_stats(buckets, timeline.stages(timeline.similarity(buckets, "repo"), "repo"), "repo")
    return made.select("repo", "stage", "start_month", "end_month", "months", "commits", "max_contributors", *(F.array_join(c, " ").alias(c) for c in ("dirs", "deps", "terms")))


def small_stage_merge(spark, d):
    staged = timeline.stages(timeline.similarity(buckets_of(spark, d), "repo"), "repo")
    return timeline.merge_small(staged, "repo")


def sparse_merge(spark, d):
    made = timeline.merge_sparse(buckets_of(spark, d), "repo")
    return made.select("repo", "month", "commits", "contributors", F.size("merged").alias("merged_months"))


def repo_timeline(spark, d):
    """Stages from merged buckets, small stages folded: the whole of the timeline."""
    buckets = timeline.merge_sparse(buckets_of(spark, d), "repo")
    staged = timeline.stages(timeline.similarity(buckets, "repo"), "repo")
    final = staged.join(timeline.merge_small(staged, "repo"), ["repo", "stage"]).select("repo", "month", F.col("new_stage").alias("stage"))
    made = timeline.stage_stats(buckets, final, "repo")
    return made.select("repo", "stage", "start_month", "end_month", "months", "commits", "max_contributors")


QUERIES = {
    f.__name__: f
    for f in (
        commit_summary, weekly_trend, file_churn_top, hotspots, authors, month_slices, month_terms, first_seen, month_end_lead, new_per_month,
        last_n_months, month_gaps, neighbor_cosine, stage_ids, stage_stats, small_stage_merge, sparse_merge, repo_timeline,
    )
}

FIELDS = "authored_at author_email message additions deletions files_changed is_my_commit".split()
COMMITS = f"""c AS (SELECT * FROM commits WHERE repo_id IS NOT NULL AND sha IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY {', '.join(f + ' DESC NULLS LAST' for f in FIELDS)}) = 1)"""
TOUCHES = "t AS (SELECT l_orderkey AS k, 'file-' || l_suppkey AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS removed FROM lineitem)"
CHURN = TOUCHES + """, h AS (SELECT path, count(DISTINCT k) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, min(k) AS first FROM t GROUP BY path),
top AS (SELECT * FROM h ORDER BY commits DESC, added DESC, first, path LIMIT 10)"""
STOP = "(" + ", ".join(f"'{w}'" for w in words.SUBJECT_STOPWORDS) + ")"
TERM_RE = "[a-z][a-z0-9_-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}"
BUCKETS = """b AS (SELECT * FROM signal_months WHERE repo IS NOT NULL AND month IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo, month ORDER BY commits DESC NULLS LAST, contributors DESC NULLS LAST, new_dirs DESC NULLS LAST, deps_added DESC NULLS LAST, top_terms DESC NULLS LAST) = 1)"""
SIMILAR_OF = """f AS (SELECT DISTINCT repo, month, 'dir:' || unnest(new_dirs) AS f, 4.0::DOUBLE AS w FROM {0}
  UNION SELECT repo, month, 'dep:' || unnest(deps_added), 4.0::DOUBLE FROM {0} UNION SELECT repo, month, 'term:' || unnest(top_terms), 1.0::DOUBLE FROM {0}),
q AS (SELECT repo, month, sum(w) AS q FROM f GROUP BY ALL),
o AS (SELECT repo, month, lag(month) OVER (PARTITION BY repo ORDER BY month) AS before FROM {0}),
dot AS (SELECT o.repo, o.month, sum(x.w) AS d FROM o JOIN f x ON x.repo = o.repo AND x.month = o.month JOIN f y ON y.repo = o.repo AND y.month = o.before AND x.f = y.f GROUP BY ALL),
near AS (SELECT o.repo, o.month, o.before,
    (substr(o.month, 1, 4)::INT * 12 + substr(o.month, 6, 2)::INT) - (substr(o.before, 1, 4)::INT * 12 + substr(o.before, 6, 2)::INT) > 1 AS gap,
    CASE WHEN o.before IS NOT NULL THEN coalesce(d / sqrt(x.q * y.q), 0.0) END AS cosine
  FROM o LEFT JOIN dot USING (repo, month) LEFT JOIN q x ON x.repo = o.repo AND x.month = o.month LEFT JOIN q y ON y.repo = o.repo AND y.month = o.before),
staged AS (SELECT repo, month, (sum(CASE WHEN cosine IS NULL OR coalesce(gap, false) OR cosine < 0.6 THEN 1 ELSE 0 END)
    OVER (PARTITION BY repo ORDER BY month ROWS UNBOUNDED PRECEDING) - 1)::INT AS stage FROM near)"""
SIMILAR = BUCKETS + ",\n" + SIMILAR_OF.format("b")

LISTS = ("new_dirs", "deps_added", "top_terms")
_ONCE = "list_filter(coalesce(o.{0}, []), lambda x, i: list_position(coalesce(o.{0}, []), x) = i)"
_UNITED = ", ".join(f"CASE WHEN j THEN list_concat(h.{c}, list_filter({_ONCE.format(c)}, lambda x: NOT list_contains(h.{c}, x))) ELSE coalesce(o.{c}, []) END" for c in LISTS)
_START = ", ".join(f"coalesce(o.{c}, []) AS {c}" for c in LISTS)
#: Months in order, each folded into the bucket before where it is sparse and near; a row for each month with the bucket so far.
MERGED = BUCKETS + f""",
months AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY month) AS k FROM b WHERE commits > 0 AND regexp_full_match(month, '[0-9]{{4}}-(0[1-9]|1[0-2])')),
h AS (
  SELECT repo, k, month, commits, coalesce(contributors, 0) AS contributors, {_START}, 0 AS merged, 1 AS bucket FROM months o WHERE k = 1
  UNION ALL
  SELECT o.repo, o.k, CASE WHEN j THEN h.month ELSE o.month END, CASE WHEN j THEN h.commits + o.commits ELSE o.commits END,
    CASE WHEN j THEN greatest(h.contributors, coalesce(o.contributors, 0)) ELSE coalesce(o.contributors, 0) END,
    {_UNITED},
    CASE WHEN j THEN h.merged + 1 ELSE 0 END, CASE WHEN j THEN h.bucket ELSE h.bucket + 1 END
  FROM (SELECT h.*, o.commits < 2 AND (substr(o.month, 1, 4)::INT * 12 + substr(o.month, 6, 2)::INT) - (substr(h.month, 1, 4)::INT * 12 + substr(h.month, 6, 2)::INT) <= 3 AS j
    FROM h JOIN months o ON o.repo = h.repo AND o.k = h.k + 1) h JOIN months o ON o.repo = h.repo AND o.k = h.k + 1),
merged AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo, bucket ORDER BY k DESC) = 1)"""

SQL = {
    "commit_summary": f"""WITH {COMMITS},
m AS (SELECT repo_id, substr(authored_at, 1, 7) AS month, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT repo_id, string_agg(month || ':' || n, ',' ORDER BY month) AS activity_by_month FROM m WHERE month IS NOT NULL GROUP BY ALL)
SELECT repo_id, min(authored_at) AS first_commit_at, max(authored_at) AS last_commit_at, count(*) AS commit_count,
  count(DISTINCT author_email) AS contributor_count, any_value(activity_by_month) AS activity_by_month
FROM c LEFT JOIN a USING (repo_id) GROUP BY repo_id""",
    "weekly_trend": f"""WITH {COMMITS}
SELECT coalesce(strftime(date_trunc('week', try_cast(authored_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC'), '%Y-%m-%d'), '') AS week,
  count(*) AS commits, coalesce(sum(additions), 0)::BIGINT AS added, coalesce(sum(deletions), 0)::BIGINT AS removed FROM c GROUP BY 1""",
    "file_churn_top": f"WITH {CHURN} SELECT * FROM top",
    "hotspots": f"""WITH {CHURN}, n AS (SELECT count(*) AS n FROM orders),
x AS (SELECT top.*, commits / greatest(n, 1) AS share FROM top, n),
y AS (SELECT path, commits, added, CASE WHEN share >= 0.15 AND added >= 300 OR added >= 2000 THEN 'HIGH' WHEN commits >= 3 THEN 'MEDIUM' END AS level,
  round_even(100 * share, 0)::BIGINT AS share_pct FROM x)
SELECT * FROM y WHERE level IS NOT NULL""",
    "authors": """WITH a AS (SELECT coalesce(nullif(authorName, ''), 'unknown') AS author, count(*) AS commits, coalesce(sum(linesAdded), 0)::BIGINT AS added,
  max(try_cast(committedAt AS TIMESTAMPTZ)) AS latest FROM (SELECT DISTINCT * FROM gitlog) GROUP BY 1)
SELECT row_number() OVER (ORDER BY commits DESC, latest DESC NULLS FIRST, author)::INT AS place, author, commits, added FROM a""",
    "month_slices": f"""WITH {COMMITS}, m AS (SELECT *, substr(authored_at, 1, 7) AS month FROM c WHERE authored_at IS NOT NULL),
x AS (SELECT repo_id, month, sha, regexp_extract_all(lower(message), '{TERM_RE}') AS l FROM m),
t AS (SELECT repo_id, month, sha, l[p] AS term, p FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM
  (SELECT repo_id, month, sha, list_filter(l, lambda w: w NOT IN {STOP}) AS l FROM x))),
j AS (SELECT repo_id, month, term, count(*) AS n, min((sha, p)) AS first FROM t GROUP BY ALL),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY repo_id, month ORDER BY n DESC, first, term) <= 5),
l AS (SELECT repo_id, month, string_agg(term, ' ' ORDER BY n DESC, first, term) AS top_terms FROM k GROUP BY ALL)
SELECT repo_id, month, count(*) AS commits, count(DISTINCT coalesce(author_email, 'unknown')) AS contributors, coalesce(any_value(top_terms), '') AS top_terms
FROM m LEFT JOIN l USING (repo_id, month) GROUP BY repo_id, month""",
    "month_terms": f"""WITH {COMMITS}, x AS (SELECT substr(authored_at, 1, 7) AS month, sha, list_filter(regexp_extract_all(lower(message), '{TERM_RE}'), lambda w: w NOT IN {STOP}) AS l FROM c),
t AS (SELECT month, sha, l[p] AS term, p FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM x)),
k AS (SELECT month, term, count(*) AS n, min((sha, p)) AS first FROM t GROUP BY ALL)
SELECT month, row_number() OVER (PARTITION BY month ORDER BY n DESC, first, term)::INT AS place, term, n FROM k QUALIFY place <= 5""",
    "first_seen": "SELECT repo, dir, min(month) AS first_month FROM (SELECT repo, month, unnest(new_dirs) AS dir FROM signal_months) GROUP BY ALL",
    "month_end_lead": f"""WITH {COMMITS}, m AS (SELECT repo_id, sha, authored_at, substr(authored_at, 1, 7) AS month FROM c)
SELECT repo_id, month, sha FROM (SELECT *, lead(month) OVER (PARTITION BY repo_id ORDER BY authored_at NULLS FIRST, sha) AS after FROM m) WHERE after IS NULL OR after <> month""",
    "new_per_month": """WITH o AS (SELECT repo, month, list_sort(list_distinct(flatten(list(top_terms)))) AS l FROM signal_months GROUP BY ALL),
n AS (SELECT *, lag(l) OVER (PARTITION BY repo ORDER BY month) AS b FROM o)
SELECT repo, month, array_to_string(list_sort(list_filter(l, lambda x: NOT coalesce(list_contains(b, x), false))), ' ') AS added FROM n""",
    "last_n_months": """SELECT DISTINCT repo, month, commits, contributors FROM signal_months
QUALIFY dense_rank() OVER (PARTITION BY repo ORDER BY month DESC) <= 3""",
    "month_gaps": f"WITH {SIMILAR} SELECT repo, month FROM near WHERE gap",
    "neighbor_cosine": f"WITH {SIMILAR} SELECT repo, month, round_even(cosine, 6) AS cosine FROM near",
    "stage_ids": f"WITH {SIMILAR} SELECT repo, month, stage FROM staged",
    "stage_stats": f"""WITH {SIMILAR}
SELECT repo, stage, min(month) AS start_month, max(month) AS end_month, count(*) AS months, sum(commits)::BIGINT AS commits, max(contributors) AS max_contributors,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(new_dirs, []))))), ' ') AS dirs,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(deps_added, []))))), ' ') AS deps,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(top_terms, [])))))[1:8], ' ') AS terms
FROM b JOIN staged USING (repo, month) GROUP BY repo, stage""",
    "sparse_merge": f"""WITH RECURSIVE {MERGED} SELECT repo, month, commits::BIGINT AS commits, contributors, merged::INT AS merged_months FROM merged""",
    "repo_timeline": f"""WITH RECURSIVE {MERGED}, {SIMILAR_OF.format("merged")},
n AS (SELECT repo, stage, count(*) AS n FROM staged GROUP BY ALL),
w AS (SELECT repo, stage, (sum(CASE WHEN stage = 0 OR n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY stage ROWS UNBOUNDED PRECEDING) - 1)::INT AS new_stage FROM n)
SELECT repo, new_stage AS stage, min(month) AS start_month, max(month) AS end_month, count(*) AS months, sum(commits)::BIGINT AS commits, max(contributors) AS max_contributors
FROM merged JOIN staged USING (repo, month) JOIN w USING (repo, stage) GROUP BY ALL""",
    "small_stage_merge": f"""WITH {SIMILAR}, n AS (SELECT repo, stage, count(*) AS n FROM staged GROUP BY ALL)
SELECT repo, stage, (sum(CASE WHEN stage = 0 OR n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY stage ROWS UNBOUNDED PRECEDING) - 1)::INT AS new_stage FROM n""",
}
