"""Queries over pairs, names and markup."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.time import instant
from repolith.llm import cooccur, link, setjoin, sitetree
from repolith.session import pin
from repolith.storage import table


def current_topics(repos: DataFrame) -> DataFrame:
    """(repo_id, items) of each repository's current row; a list that can't be read is empty.

    On ties of both instants the greatest text counts.
    """
    row = F.struct(instant("last_synced_at").alias("t"), F.col("arrived_at").alias("a"), F.col("topics_json").alias("j"))
    now = repos.filter("id is not null").groupBy(F.col("id").alias("repo_id")).agg(F.max(row).alias("r"))
    items = F.from_json("r.j", "array<string>")
    return now.select("repo_id", F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))).alias("items"))


def declared(dependencies: DataFrame) -> DataFrame:
    """(repo_id, name) with names lower-cased and trimmed."""
    return dependencies.select("repo_id", F.lower(F.trim("name")).alias("name"))


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, id, body) of release notes and issue titles."""
    notes = table(pin(spark), d, "releases").select("repo_id", "id", F.col("notes").alias("body"))
    titles = table(spark, d, "issues").select("repo_id", "id", F.col("title").alias("body"))
    return notes.unionByName(titles)


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of release notes and issue titles; a repository is a host."""
    made = sitetree.clean(pages_of(spark, d), F.col("repo_id"), F.col("id"), F.col("body"))
    return made.withColumnRenamed("record", "record_id")


def p3_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Importance of each repository's tree of release notes and issue titles, from which ``p3_clean`` removes."""
    return sitetree.host_importance(sitetree.read_pages(pages_of(spark, d), F.coalesce("repo_id", F.lit("")), F.col("id"), F.col("body")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_clean(spark, d).select("record_id", F.explode("structure").alias("structure")).distinct()


def identities(spark: SparkSession, d: str, commits: bool = True) -> DataFrame:
    """(identity, name, email): the rows of authors, and what gitlog and, unless told not to, commits have besides.

    An identity is named ``author:ID``; one of gitlog or commits, whose name and
    address no author has together, by a hash of both.
    """
    hashed = F.sha2(F.to_json(F.struct("name", "email"), {"ignoreNullFields": "false"}), 256)
    authors = table(pin(spark), d, "authors").select("author_id", F.col("authorName").alias("name"), F.col("authorEmail").alias("email")).withColumn("typed", hashed)
    rest = table(spark, d, "gitlog").select(F.col("authorName").alias("name"), F.col("authorEmail").alias("email"))
    if commits:
        boxes = table(spark, d, "commits").filter("author_email is not null").select(F.lit(None).cast("string").alias("name"), F.lower(F.trim("author_email")).alias("email"))
        rest = rest.unionByName(boxes)
    rest = rest.distinct().withColumn("typed", hashed).join(authors.select("typed"), "typed", "left_anti")
    own = authors.filter("author_id is not null").select(F.concat(F.lit("author:"), F.col("author_id").cast("string")).alias("identity"), "name", "email")
    return own.unionByName(rest.select(F.concat(F.lit("typed:"), "typed").alias("identity"), "name", "email"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every identity of authors, gitlog and commits."""
    return link.link(identities(spark, d), "identity", "name", "email")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of authors; identities of gitlog are links between them.

    Addresses of commits come without a name, so each goes with one mailbox at
    most and cannot link two authors: they are left to ``p4_entities``.
    """
    linked = link.link(identities(spark, d, commits=False), "identity", "name", "email").filter(F.startswith("identity", F.lit("author:")))
    return link.pairs(linked.select(F.expr("bigint(substr(identity, 8))").alias("author_id"), "entity"), "author_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    topics = current_topics(table(pin(spark), d, "repos"))
    names = declared(table(spark, d, "dependencies")).filter("repo_id is not null and name is not null")
    names = names.groupBy("repo_id").agg(F.collect_set("name").alias("items"))
    made = [
        setjoin.similar(df, "repo_id", "items", Fraction(6, 10), least=3).select(F.lit(field).alias("field"), "repo_id_a", "repo_id_b")
        for field, df in (("topics", topics), ("dependencies", names))
    ]
    return made[0].unionByName(made[1])


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every repository with the class of its set of topics or dependencies, and its number of similar repositories."""
    topics = current_topics(table(pin(spark), d, "repos"))
    names = declared(table(spark, d, "dependencies")).filter("repo_id is not null and name is not null")
    names = names.groupBy("repo_id").agg(F.collect_set("name").alias("items"))
    made = [
        setjoin.class_links(df, "repo_id", "items", Fraction(6, 10), least=3)[0].select(F.lit(field).alias("field"), "repo_id", "class", "records", "links")
        for field, df in (("topics", topics), ("dependencies", names))
    ]
    return made[0].unionByName(made[1])


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(declared(table(pin(spark), d, "dependencies")), "repo_id", "name", min_count=2)


def p7_all(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of names that meet in any repository; ``p7_pairs`` has those that meet in two or more."""
    return cooccur.cooccurrence(declared(table(pin(spark), d, "dependencies")), "repo_id", "name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    made = cooccur.cooccurrence(declared(table(pin(spark), d, "dependencies")), "repo_id", "name", min_count=5, min_lift=4)
    return made.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities, "p3_found": p3_found, "p3_clean": p3_clean, "p3_hosts": p3_hosts, "p5_found": p5_found, "p5_classes": p5_classes, "p7_found": p7_found, "p7_pairs": p7_pairs, "p7_all": p7_all}

PAIRS_SQL = """
WITH d AS (SELECT DISTINCT repo_id, lower(trim(name, ' ')) AS name FROM dependencies WHERE repo_id IS NOT NULL AND name IS NOT NULL),
n AS (SELECT count(DISTINCT repo_id) AS n FROM dependencies),
s AS (SELECT name, count(*) AS k FROM d GROUP BY ALL),
p AS (SELECT x.name AS a, y.name AS b, count(*) AS n_ab FROM d x JOIN d y ON x.repo_id = y.repo_id AND x.name < y.name GROUP BY ALL)
"""

SETS_SQL = """
WITH now AS (
  SELECT id, topics_json FROM repos WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_synced_at::TIMESTAMPTZ DESC, arrived_at DESC, topics_json DESC NULLS LAST) = 1),
i AS (
  SELECT DISTINCT 'topics' AS field, id AS repo_id, lower(trim(x, ' ')) AS item
  FROM (SELECT id, unnest(from_json(CASE WHEN json_valid(topics_json) THEN topics_json END, '["VARCHAR"]')) AS x FROM now)
  UNION
  SELECT 'dependencies', repo_id, lower(trim(name, ' ')) FROM dependencies WHERE repo_id IS NOT NULL AND name IS NOT NULL),
n AS (SELECT field, repo_id, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 3),
c AS (
  SELECT x.field, x.repo_id AS a, y.repo_id AS b, count(*) AS c
  FROM i x JOIN i y ON x.field = y.field AND x.item = y.item AND x.repo_id < y.repo_id GROUP BY ALL),
p AS (
  SELECT c.field, a, b FROM c JOIN n x ON x.field = c.field AND x.repo_id = a JOIN n y ON y.field = c.field AND y.repo_id = b
  WHERE 10 * c >= 6 * (x.n + y.n - c))
"""

SQL = {
    "p5_found": SETS_SQL + "SELECT field, a AS repo_id_a, b AS repo_id_b FROM p",
    "p5_classes": SETS_SQL
    + """, w AS (
  SELECT field, repo_id, substr(sha256(to_json(list(item ORDER BY item))::VARCHAR), 1, 32) AS class FROM i WHERE item IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'topics', id, substr(sha256('[]'), 1, 32) FROM now
    WHERE len(list_filter(from_json(CASE WHEN json_valid(topics_json) THEN topics_json END, '["VARCHAR"]'), lambda x: x IS NOT NULL)) = 0),
k AS (SELECT field, class, count(*) AS records FROM w GROUP BY ALL),
l AS (SELECT field, r, count(*) AS links FROM (SELECT field, a AS r FROM p UNION ALL SELECT field, b FROM p) GROUP BY ALL)
SELECT w.field, repo_id, class, records, coalesce(links, 0) AS links FROM w JOIN k USING (field, class) LEFT JOIN l ON l.field = w.field AND l.r = w.repo_id""",
    "p7_found": PAIRS_SQL
    + """SELECT a AS name_a, b AS name_b FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b, n
WHERE n_ab >= 5 AND n_ab * n >= 4 * x.k * y.k""",
    "p7_pairs": PAIRS_SQL
    + """SELECT a, b, n_ab, x.k AS n_a, y.k AS n_b, n_ab * n / (x.k * y.k) AS lift, ln(n_ab * n / (x.k * y.k)) AS pmi
FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b, n WHERE n_ab >= 2""",
    "p7_all": PAIRS_SQL
    + """SELECT a, b, n_ab, x.k AS n_a, y.k AS n_b, n_ab * n / (x.k * y.k) AS lift, ln(n_ab * n / (x.k * y.k)) AS pmi
FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b, n""",
}
