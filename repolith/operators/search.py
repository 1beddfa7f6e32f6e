"""Retrieval over texts: postings, matches of any phrase, context for a question."""

from __future__ import annotations

import unicodedata
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.dates import parse_range
from repolith.rules import words

#: Latin letters with marks and what they are without, by rule and not by table.
_MARKED = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(i))[0] != chr(i)]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, Latin marks taken off; a run of ideographs is one token."""
    plain = F.translate(F.lower(text), "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, token) of every token; null texts have none."""
    return df.filter(F.col(text).isNotNull()).select(F.col(doc), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def match_any(df: DataFrame, text: Column, phrases: list[str]) -> DataFrame:
    """The rows in whose text one of the phrases stands as consecutive tokens.

    Phrases are few and known when the plan is made, so they are literals and
    the text is read once; there is no join with postings.
    """
    wanted = [unicodedata.normalize("NFC", p) for p in phrases]
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    tests = [padded.contains(F.concat(F.lit(" "), F.array_join(tokens(F.lit(p)), " "), F.lit(" "))) & (F.size(tokens(F.lit(p))) > 0) for p in wanted]
    if not tests:
        return df.filter(F.lit(False))
    keep = tests[0]
    for t in tests[1:]:
        keep = keep | t
    return df.filter(F.coalesce(keep, F.lit(False)))


def match_postings(index: DataFrame, doc: str, phrases: list[str]) -> DataFrame:
    """(doc) of the documents in which one of the phrases stands as consecutive tokens, from their postings.

    Only the postings of the phrases' tokens are read; a phrase stands where all
    of its tokens agree on the place of its first.  Phrases are few, and their
    tokens come as a broadcast table.  A phrase without tokens matches nothing.
    """
    spark = index.sparkSession
    wanted = [unicodedata.normalize("NFC", p) for p in phrases]
    split = spark.createDataFrame([(i, p) for i, p in enumerate(wanted)], "phrase int, text string").select("phrase", F.size(tokens(F.col("text"))).alias("size"), F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    hit = index.join(F.broadcast(split), "token").groupBy(doc, "phrase", "size", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("n"))
    return hit.filter("n = size").select(doc).distinct()


def match_expression(terms: list[str]) -> str:
    """The terms as one expression: each a quoted phrase without quotes of its own, any of them."""
    return " OR ".join(f'"{t}"' for t in (x.replace('"', "").strip() for x in terms) if t)


def query_terms(question: Column) -> Column:
    """Up to eight distinct terms of a question: Latin words, and ideographs left after stopwords are taken out."""
    stop = sorted((w for w in words.QUESTION_STOPWORDS if not w.isascii()), key=lambda w: (-len(w), w))

    def cleaned(raw: Column) -> Column:
        for w in stop:
            raw = F.replace(raw, F.lit(w), F.lit(" "))
        return F.split(F.trim(raw), " +")

    raw = F.regexp_extract_all(F.lower(question), F.lit(words.QUESTION_TERM), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda r: F.when(r.rlike("^[a-z]"), F.array(F.regexp_replace(r, "^[_-]+|[_-]+$", ""))).otherwise(cleaned(r))))
    kept = F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(words.QUESTION_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, words.QUERY_TERMS)


def in_range(value: Column, span: tuple[date, date] | None) -> Column:
    """Whether the first ten characters lie in the range; no range and no value pass."""
    if span is None:
        return F.lit(True)
    return value.isNull() | (value == "") | F.substring(value, 1, 10).between(span[0].isoformat(), span[1].isoformat())


def context(
    commits: DataFrame, issues: DataFrame, repos: DataFrame, question: str, today: date, limit: int = words.EVIDENCE, index: dict[str, DataFrame] | None = None
) -> DataFrame:
    """(ord, source, kind, text): what the store says to a question, at most ``limit`` blocks (a report).

    ``commits`` (id, full_name, authored_at, message), ``issues`` (id, full_name,
    number, state, title, opened_at), ``repos`` (id, full_name, description).
    Per kind the first matches by id are taken, then those out of the question's
    range are left out; without terms the latest commits stand in.  ``index``
    may have the postings of commits, issues and repos by these names; then
    matches come from a join with them, and texts are not scanned.
    """

    def matched(name: str, rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
        if not index or name not in index:
            return match_any(rows, F.col(text), terms)
        return rows.join(match_postings(index[name], "id", terms), "id", "left_semi")

    span = parse_range(question, today)
    spark = commits.sparkSession
    terms = spark.range(1).select(query_terms(F.lit(question)).alias("t")).first()["t"]
    snippet = F.substring("message", 1, words.SNIPPET)
    commit = [F.concat(F.lit("commit:"), "full_name", F.lit("@"), F.substring("authored_at", 1, 10)).alias("source"), F.lit("commit").alias("kind"), snippet.alias("text")]
    if not terms:
        recent = commits.orderBy(F.desc("authored_at"), "id").limit(limit).filter(in_range(F.col("authored_at"), span))
        blocks = recent.select(F.lit(0).alias("k"), F.col("id").alias("o"), *commit)
    else:
        c = matched("commits", commits, "message", terms).orderBy("id").limit(3 * limit).filter(in_range(F.col("authored_at"), span))
        i = matched("issues", issues, "title", terms).orderBy("id").limit(3 * limit).filter(in_range(F.col("opened_at"), span))
        r = matched("repos", repos, "description", terms).orderBy("id").limit(limit)
        blocks = c.select(F.lit(0).alias("k"), F.col("id").alias("o"), *commit)
        blocks = blocks.unionByName(
            i.select(
                F.lit(1).alias("k"),
                F.col("id").alias("o"),
                F.concat(F.lit("issue:"), "full_name", F.lit("#"), F.col("number").cast("string")).alias("source"),
                F.lit("issue").alias("kind"),
                F.concat(F.lit("["), "state", F.lit("] "), "title").alias("text"),
            )
        ).unionByName(
            r.select(F.lit(2).alias("k"), F.col("id").alias("o"), F.concat(F.lit("repo:"), "full_name").alias("source"), F.lit("repo").alias("kind"), F.coalesce("description", F.lit("")).alias("text"))
        )
    key = Window.partitionBy(F.concat("source", F.substring("text", 1, words.EVIDENCE_KEY))).orderBy("k", "o")
    first = blocks.withColumn("n", F.row_number().over(key)).filter("n = 1")
    place = F.row_number().over(Window.orderBy("k", "o"))  # at most seven times the limit
    return first.withColumn("ord", place).filter(F.col("ord") <= limit).select("ord", "source", "kind", "text")
