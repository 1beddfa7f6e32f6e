"""Queries over whole texts: encoding, mixing, splitting, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import encode, mix, split, terms
from repolith.session import pin
from repolith.storage import materialize, table

#: Size limit of a piece, and tokens that it repeats of the piece before.
LIMIT, OVERLAP = 2048, 128


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return terms.log_entropy(table(pin(spark), d, "commits"), "repo_id", "sha", "message")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cases are weighted terms: ``weight`` is not negative, which the plan doesn't know and computes."""
    return p6_weights(spark, d).filter("tf >= 4 and records <= 3 and weight >= 0").select("repo_id", "term")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(pin(spark), d, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once as the mixture reads it several times."""
    docs = table(pin(spark), d, "documents")
    return materialize(encode.sizes(docs, {"doc_id": F.col("doc_id"), "source": F.col("source")}, "text"), "sizes")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(_sizes(spark, d), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p9_mix(spark, d), table(spark, d, "mix_targets"), "source", "n_tokens")


def p9_held(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source that occurs has its share due, as far as whole documents allow, and its repeats.

    A source misses its size by less than one document; so its share is off by
    its largest document, and by what all the others may miss of the total.
    """
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    report = mix.shares(mix.mix(sizes, targets, "doc_id", "source", "n_tokens"), targets, "source", "n_tokens").filter("due_share is not null")
    largest = sizes.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("n_tokens").alias("largest"))
    report = materialize(report.join(largest, "source"), "report")  # one row for each listed source
    total = report.agg(F.sum("tokens").alias("total"), F.sum("largest").alias("most"))
    report = report.crossJoin(total)  # one row
    holds = F.abs(F.col("tokens") - F.col("due_share") * F.col("total")) <= F.col("largest") + F.col("due_share") * F.col("most")
    return report.select("source", F.bround("due_share", 9).alias("due_share"), holds.alias("holds"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(pin(spark), d, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts above the limit: those with more than one piece."""
    return p10_pieces(spark, d).filter("piece = 1").select("doc_id").distinct()


QUERIES = {
    "p6_found": p6_found,
    "p6_weights": p6_weights,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_held": p9_held,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

TERMS_SQL = """
WITH c AS (
  SELECT DISTINCT repo_id, sha, unnest(regexp_extract_all(lower(message), '[a-z][a-z0-9_-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}')) AS term
  FROM commits WHERE repo_id IS NOT NULL AND sha IS NOT NULL),
l AS (SELECT repo_id, term, count(*) AS tf FROM c GROUP BY ALL),
s AS (SELECT term, count(*) AS records, sum(tf) AS a, sum(tf * ln(tf)) AS x FROM l GROUP BY ALL),
n AS (SELECT greatest(2, count(DISTINCT repo_id)) AS n FROM commits WHERE sha IS NOT NULL)
"""

SQL = {
    "p9_held": """
WITH here AS (SELECT DISTINCT lower(trim(source, ' ')) AS source FROM documents WHERE text <> ''),
t AS (SELECT lower(trim(m.source, ' ')) AS source, target_share FROM mix_targets m WHERE lower(trim(m.source, ' ')) IN (SELECT source FROM here) AND target_share > 0 AND max_repeats > 0)
SELECT source, round_even(target_share / sum(target_share) OVER (), 9) AS due_share, true AS holds, true AS within_repeats FROM t""",
    "p6_found": TERMS_SQL + "SELECT repo_id, term FROM l JOIN s USING (term) WHERE tf >= 4 AND records <= 3",
    "p6_weights": TERMS_SQL
    + """SELECT repo_id, term, tf, records, greatest(ln(1 + tf) * (1 - (ln(a) - x / a) / ln(n)), 0.0) AS weight
FROM l JOIN s USING (term), n""",
}
