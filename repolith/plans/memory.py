"""The store as Parquet tables in a folder, and what a client asks of it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.time import month_key
from repolith.operators import activity, search, store, timeline

#: The keys of each table.
KEYS = {"repos": ["id"], "commits": ["id"], "issues": ["id"], "releases": ["id"], "dependencies": ["repo_id", "name", "kind"], "sync_state": ["entity"]}
#: What a lookup shows of each kind.
SHOWN = {
    "repo": ("repos", ["full_name", "description", "primary_language", "stars", "pushed_at"]),
    "commit": ("commits", ["sha", "authored_at", "message", "additions", "deletions"]),
    "issue": ("issues", ["number", "title", "state", "opened_at"]),
}


class Memory:
    """Tables ``FOLDER/NAME.parquet``, one row for each key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table; of several rows with one key the greatest in all columns."""
        return store.latest(self.spark.read.parquet(f"{self.folder}/{name}.parquet"), KEYS[name], [])

    def named(self, name: str) -> DataFrame:
        """A table of items with the names of their repositories."""
        return self.table(name).join(self.table("repos").select(F.col("id").alias("repo_id"), "full_name"), "repo_id")

    def search(self, question: str, today: date, limit: int = 8) -> DataFrame:
        commits = self.named("commits").select("id", "full_name", "authored_at", "message")
        issues = self.named("issues").select("id", "full_name", "number", "state", "title", "opened_at")
        return search.context(commits, issues, self.table("repos").select("id", "full_name", "description"), question, today, limit, self.index())

    def index(self) -> dict[str, DataFrame]:
        """The postings that are stored beside the tables, by table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = {n: f"{self.folder}/index_{n}.parquet" for n in ("commits", "issues", "repos")}
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return {n: self.spark.read.parquet(p) for n, p in at.items() if path(p).getFileSystem(conf).exists(path(p))}

    def get(self, ident: str) -> DataFrame:
        """(id, kind, uri, <fields>) of one entity; an error for what is no identifier or can't be shown."""
        parts = ident.split(":")
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"not an identifier: {ident}")
        if parts[1] not in SHOWN:
            raise ValueError(f"not shown: {parts[1]}")
        name, fields = SHOWN[parts[1]]
        rows = self.table(name) if name == "repos" else self.named(name)
        uri = store.source_uri(F.lit(parts[1]), F.col("full_name"), F.lit(parts[2]))
        return rows.filter(F.col("id") == ident).select("id", F.lit(parts[1]).alias("kind"), uri.alias("uri"), *fields)

    def months(self, ident: str) -> DataFrame:
        """Monthly slices of one repository; a term counts once in a message."""
        rows = self.table("commits").filter(F.col("repo_id") == ident).withColumn("month", month_key("authored_at")).filter("month is not null")
        counts = rows.groupBy("repo_id", "month").agg(F.count("*").alias("commits"), F.count_distinct(F.coalesce("author_email", F.lit("unknown"))).alias("contributors"))
        terms = rows.select("repo_id", "month", F.col("authored_at").alias("o"), "sha", F.posexplode(F.array_distinct(activity.terms_of(F.col("message")))).alias("p", "term"))
        top = activity.top_terms(terms.withColumn("ord", F.struct("o", "sha", "p")), ["repo_id", "month"])
        lists = top.groupBy("repo_id", "month").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("top_terms"))
        none = F.array().cast("array<string>")
        return counts.join(lists, ["repo_id", "month"], "left").withColumns({"new_dirs": none, "deps_added": none, "top_terms": F.coalesce("top_terms", none)})

    def timeline(self, ident: str, theta: float = 0.6) -> DataFrame:
        buckets = timeline.merge_sparse(self.months(ident), "repo_id")
        staged = timeline.stages(timeline.similarity(buckets, "repo_id"), "repo_id", theta)
        final = staged.join(timeline.merge_small(staged, "repo_id"), ["repo_id", "stage"]).select("repo_id", "month", F.col("new_stage").alias("stage"))
        return timeline.stage_stats(buckets, final, "repo_id")

    def related(self, ident: str) -> DataFrame:
        """Declared dependencies of a repository by kind and name."""
        return self.table("dependencies").filter(F.col("repo_id") == ident).select("kind", "name", "version").orderBy("kind", "name")

    def observe(self) -> DataFrame:
        """One row: how much there is, the last sync, and whether there is too little to compare."""
        one = [self.table(n).agg(F.count("*").alias(n)) for n in ("repos", "commits", "issues")]
        synced = self.table("sync_state").agg(F.max("last_synced_at").alias("last_sync"))
        return one[0].crossJoin(one[1]).crossJoin(one[2]).crossJoin(synced).withColumn("too_few", F.col("repos") < 2)  # one row each
