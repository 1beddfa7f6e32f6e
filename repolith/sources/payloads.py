"""Pages of a forge's interface, saved as JSON files, as rows of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators.store import entity_id

#: What is read of each kind of item; nothing is inferred.
ITEMS = {
    "repos": "full_name:string, description:string, language:string, stargazers_count:long, forks_count:long, fork:boolean, archived:boolean, visibility:string, created_at:string, pushed_at:string, topics:array<string>",
    "commits": "sha:string, author:struct<login:string>, commit:struct<message:string,author:struct<date:string,email:string>>, stats:struct<additions:long,deletions:long,total:long>",
    "issues": "number:long, title:string, state:string, pull_request:string, labels:array<struct<name:string>>, created_at:string, closed_at:string",
    "releases": "tag_name:string, name:string, published_at:string, body:string",
}


def read_pages(spark: SparkSession, path: str, kind: str, per_page: int = 100, max_pages: int = 10) -> DataFrame:
    """Items of the pages ``REPO__N.json`` in a folder, page after page, as (repo, page, ord, item).

    As when paging over the network, a repository's pages end at the first that
    is missing, no list, empty or short, and after ``max_pages``; ``__`` in a
    file's name stands for ``/`` of the repository's.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    name = F.regexp_extract("file", r"^(.*)__([0-9]+)\.json$", 1)
    page = F.regexp_extract("file", r"^(.*)__([0-9]+)\.json$", 2).try_cast("int")
    items = F.from_json("value", f"array<struct<{ITEMS[kind]}>>")
    pages = files.select(F.replace(name, F.lit("__"), F.lit("/")).alias("repo"), page.alias("page"), items.alias("items")).filter(F.col("page") <= max_pages)
    full = pages.groupBy("repo").agg(F.array_sort(F.collect_list(F.when(F.size("items") >= per_page, F.col("page")))).alias("full"))  # at most max_pages
    # how many full pages there are from the first on without a gap
    run = F.size(F.filter(F.transform("full", lambda p, i: p == i + 1), lambda x: x))
    kept = pages.join(full.withColumn("last", run + 1), "repo").filter("page <= last")
    return kept.select("repo", "page", F.posexplode("items").alias("ord", "item"))


def _id(kind: str, native: Column) -> Column:
    return entity_id(F.lit("github"), F.lit(kind), native)


def repos(items: DataFrame, now: str) -> DataFrame:
    r = F.col("item")
    return items.filter("item.full_name is not null").select(
        _id("repo", r["full_name"]).alias("id"), r["full_name"].alias("full_name"), r["description"].alias("description"), r["language"].alias("primary_language"),
        F.coalesce(r["stargazers_count"], F.lit(0)).alias("stars"), F.coalesce(r["forks_count"], F.lit(0)).alias("forks"),
        F.coalesce(r["fork"], F.lit(False)).cast("long").alias("is_fork"), F.coalesce(r["archived"], F.lit(False)).cast("long").alias("is_archived"),
        F.coalesce(r["visibility"], F.lit("public")).alias("visibility"), r["created_at"].alias("created_at"), r["pushed_at"].alias("pushed_at"),
        F.to_json(F.coalesce(r["topics"], F.array().cast("array<string>"))).alias("topics_json"), F.lit("owner").alias("my_role"), F.lit(now).alias("first_synced_at"), F.lit(now).alias("last_synced_at"),
    )


def commits(items: DataFrame, login: str | None) -> DataFrame:
    """Items without a sha are left out; a commit is one's own if its author's login is, in any case."""
    c = F.col("item")
    mine = F.coalesce(F.lower(c["author"]["login"]) == F.lit((login or "").lower()), F.lit(False)) if login else F.lit(False)
    return items.filter("item.sha != ''").select(
        _id("commit", F.concat("repo", F.lit("@"), c["sha"])).alias("id"), _id("repo", F.col("repo")).alias("repo_id"), c["sha"].alias("sha"),
        c["commit"]["author"]["date"].alias("authored_at"), c["commit"]["author"]["email"].alias("author_email"), F.coalesce(c["commit"]["message"], F.lit("")).alias("message"),
        c["stats"]["additions"].alias("additions"), c["stats"]["deletions"].alias("deletions"), c["stats"]["total"].alias("files_changed"), mine.cast("long").alias("is_my_commit"),
    )


def issues(items: DataFrame) -> DataFrame:
    i = F.col("item")
    return items.filter("item.number is not null").select(
        _id("issue", F.concat("repo", F.lit("#"), i["number"].cast("string"))).alias("id"), _id("repo", F.col("repo")).alias("repo_id"), i["number"].alias("number"),
        F.coalesce(i["title"], F.lit("")).alias("title"), F.coalesce(i["state"], F.lit("open")).alias("state"), i["pull_request"].isNotNull().cast("long").alias("is_pr"),
        F.to_json(F.transform(F.coalesce(i["labels"], F.array().cast("array<struct<name:string>>")), lambda x: F.coalesce(x["name"], F.lit("")))).alias("labels_json"),
        i["created_at"].alias("opened_at"), i["closed_at"].alias("closed_at"),
    )


def releases(items: DataFrame) -> DataFrame:
    r = F.col("item")
    tag = F.coalesce(r["tag_name"], F.lit(""))
    return items.select(
        _id("release", F.concat("repo", F.lit("@"), tag)).alias("id"), _id("repo", F.col("repo")).alias("repo_id"), tag.alias("tag_name"), r["name"].alias("name"),
        r["published_at"].alias("published_at"), r["body"].alias("notes"),
    )
