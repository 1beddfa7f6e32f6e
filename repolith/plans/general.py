"""Queries of the general training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.time import instant, iso_seconds
from repolith.operators import history, incremental
from repolith.session import pin
from repolith.storage import new_folder, table


def clean(c: str):
    """Trimmed text; empty is null."""
    text = F.trim(c)
    return F.when(text != "", text)


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole bitemporal ledger of repos; instants are microseconds."""
    attributes = {"stars": F.col("stars"), "is_archived": F.col("is_archived"), "description": clean("description")}
    rows = history.ledger(table(pin(spark), d, "repos"), "id", instant("last_synced_at"), F.col("arrived_at").cast("timestamp"), attributes)
    periods = ("valid_from", "valid_to", "recorded_from", "recorded_to")
    return rows.select("id", *attributes, *(F.unix_micros(c).alias(c) for c in periods))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    attributes = {"stars": F.col("stars"), "is_archived": F.col("is_archived"), "description": clean("description")}
    rows = history.ledger(table(pin(spark), d, "repos"), "id", instant("last_synced_at"), F.col("arrived_at").cast("timestamp"), attributes)
    made = history.versions(history.as_known(rows), "id", list(attributes))
    return made.select(F.col("id").alias("repo_id"), iso_seconds(F.col("valid_from")).alias("valid_from")).distinct()


def sync_run(spark: SparkSession, d: str, runs: incremental.Runs) -> dict | None:
    """One run over repos, in the sequence of arrival, that commits the ids to be processed.

    The watermark of sync_state, by owner, says what earlier runs have done;
    arrivals after the run's limit wait.  Of rows whose arrival is unknown none
    counts as done, so they are part of every run.
    """
    repos = table(pin(spark), d, "repos")
    marks = incremental.watermarks(table(spark, d, "sync_state"), "repos:")
    attributes = {
        "description": clean("description"),
        "primary_language": F.col("primary_language"),
        "stars": F.col("stars"),
        "forks": F.col("forks"),
        "is_archived": F.col("is_archived"),
        "pushed_at": instant("pushed_at"),
    }

    def work(new: DataFrame, until: DataFrame) -> DataFrame:
        owner = F.substring_index("full_name", "/", 1)
        return incremental.pending(until, marks, "id", owner, instant("last_synced_at"), F.col("arrived_at").cast("timestamp"), attributes).select(F.col("id").alias("repo_id"))

    return runs.run(repos, "arrived_at", work, unplaced=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """What a run commits: its rows are read from the committed output."""
    runs = incremental.Runs(spark, new_folder(spark, "runs"))
    if sync_run(spark, d, runs) is None:
        return spark.createDataFrame([], "repo_id string")
    return runs.read()


QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p2_found": p2_found}

SQL = {
    "p1_ledger": """
WITH e AS (
  SELECT id, epoch_us(last_synced_at::TIMESTAMPTZ) AS v, epoch_us(arrived_at) AS r, stars, is_archived, nullif(trim(description, ' '), '') AS d
  FROM repos WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, v, r ORDER BY stars DESC NULLS LAST, is_archived DESC NULLS LAST, d DESC NULLS LAST) = 1),
f AS (SELECT id, v, min(r) AS r FROM e GROUP BY ALL),
p AS (SELECT id, v, r AS t FROM e UNION SELECT f.id, f.v, g.r FROM f JOIN f g ON g.id = f.id AND g.v > f.v AND g.r >= f.r),
u AS (SELECT p.id, p.v, p.t, min(g.v) AS until FROM p LEFT JOIN f g ON g.id = p.id AND g.v > p.v AND g.r <= p.t GROUP BY ALL),
s AS (
  SELECT u.*, stars, is_archived, d FROM u JOIN e ON e.id = u.id AND e.v = u.v AND e.r <= u.t
  QUALIFY row_number() OVER (PARTITION BY u.id, u.v, u.t ORDER BY e.r DESC) = 1),
k AS (
  SELECT *, row_number() OVER w AS k, lag(until) OVER w AS u0, lag(stars) OVER w AS s0, lag(is_archived) OVER w AS a0, lag(d) OVER w AS d0
  FROM s WINDOW w AS (PARTITION BY id, v ORDER BY t)),
c AS (SELECT * FROM k WHERE k = 1 OR until IS DISTINCT FROM u0 OR stars IS DISTINCT FROM s0 OR is_archived IS DISTINCT FROM a0 OR d IS DISTINCT FROM d0)
SELECT id, stars, is_archived, d AS description, v AS valid_from, until AS valid_to, t AS recorded_from, lead(t) OVER (PARTITION BY id, v ORDER BY t) AS recorded_to FROM c""",
    "p1_found": """
WITH r AS (
  SELECT id, last_synced_at::TIMESTAMPTZ AS t, arrived_at, stars, is_archived, nullif(trim(description, ' '), '') AS d
  FROM repos WHERE id IS NOT NULL AND try_cast(last_synced_at AS TIMESTAMPTZ) IS NOT NULL),
one AS (
  SELECT * FROM r QUALIFY row_number() OVER (
    PARTITION BY id, t ORDER BY arrived_at DESC NULLS LAST, stars DESC NULLS LAST, is_archived DESC NULLS LAST, d DESC NULLS LAST) = 1),
n AS (
  SELECT *, row_number() OVER w AS k, lag(stars) OVER w AS s0, lag(is_archived) OVER w AS a0, lag(d) OVER w AS d0
  FROM one WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT DISTINCT id AS repo_id, strftime(t AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS valid_from
FROM n WHERE k = 1 OR stars IS DISTINCT FROM s0 OR is_archived IS DISTINCT FROM a0 OR d IS DISTINCT FROM d0""",
    "p2_found": """
WITH s AS (
  SELECT substr(entity, 7) AS owner, last_synced_at::TIMESTAMPTZ AS synced, cursor,
    CASE WHEN contains(cursor, '|') THEN cursor ELSE TRY(decode(from_base64(cursor))) END AS c
  FROM sync_state WHERE starts_with(entity, 'repos:')
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last_synced_at::TIMESTAMPTZ DESC, cursor DESC NULLS LAST) = 1),
w AS (
  SELECT owner, synced, cursor IS NULL AS whole, try_cast(split_part(c, '|', 1) AS TIMESTAMPTZ) AS ct,
    substr(c, strpos(c, '|') + 1) AS cid FROM s),
r AS (
  SELECT id, last_synced_at::TIMESTAMPTZ AS t, arrived_at AT TIME ZONE 'UTC' AS arrived,
    nullif(trim(description, ' '), '') AS d, primary_language AS l, stars, forks, is_archived AS a, pushed_at::TIMESTAMPTZ AS p,
    split_part(full_name, '/', 1) AS owner
  FROM repos WHERE id IS NOT NULL),
j AS (
  SELECT r.*, coalesce(arrived <= synced AND (whole OR t < ct OR (t = ct AND id <= cid)), false) AS done
  FROM r LEFT JOIN w USING (owner)),
now AS (
  SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC NULLS LAST, arrived DESC NULLS LAST,
    d DESC NULLS LAST, l DESC NULLS LAST, stars DESC NULLS LAST, forks DESC NULLS LAST, a DESC NULLS LAST, p DESC NULLS LAST) = 1),
old AS (
  SELECT * FROM j WHERE done QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC NULLS LAST, arrived DESC NULLS LAST,
    d DESC NULLS LAST, l DESC NULLS LAST, stars DESC NULLS LAST, forks DESC NULLS LAST, a DESC NULLS LAST, p DESC NULLS LAST) = 1)
SELECT now.id AS repo_id FROM now LEFT JOIN old ON now.id = old.id
WHERE old.id IS NULL OR now.d IS DISTINCT FROM old.d OR now.l IS DISTINCT FROM old.l OR now.stars IS DISTINCT FROM old.stars
  OR now.forks IS DISTINCT FROM old.forks OR now.a IS DISTINCT FROM old.a OR now.p IS DISTINCT FROM old.p""",
}
