"""The store's life: empty tables, runs over saved pages, and the index that goes with them."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import search, store
from repolith.plans.memory import KEYS
from repolith.sources import payloads
from repolith.storage import materialize, remove

# Columns of the store's tables.
TABLES = {
    "repos": "id string, full_name string, description string, primary_language string, stars long, forks long, is_fork long, is_archived long, visibility string, "
    "created_at string, pushed_at string, topics_json string, my_role string, first_synced_at string, last_synced_at string",
    "commits": "id string, repo_id string, sha string, authored_at string, author_email string, message string, additions long, deletions long, files_changed long, is_my_commit long",
    "issues": "id string, repo_id string, number long, title string, state string, is_pr long, labels_json string, opened_at string, closed_at string",
    "releases": "id string, repo_id string, tag_name string, name string, published_at string, notes string",
    "dependencies": "repo_id string, name string, version string, kind string",
    "verdicts": "repo_id string, verdict string, reason string, decided_at string",
    "sync_state": "entity string, last_synced_at string, cursor string",
}
#: The indexed text of each table.
INDEXED = {"commits": "message", "issues": "title", "repos": "description"}
INDEX = "id string, pos int, token string"


class Store:
    """Tables ``FOLDER/NAME.parquet`` and the postings ``FOLDER/index_NAME.parquet`` of their texts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(str(PurePosixPath(self.folder) / name) if "://" not in self.folder else f"{self.folder}/{name}")

    def _has(self, name: str) -> bool:
        return self._files.exists(self._path(f"{name}.parquet"))

    def init(self) -> list[str]:
        """Make the tables that are missing, empty; gives their names.  Tables that exist are left as they are."""
        made = []
        for name, schema in [*TABLES.items(), *((f"index_{n}", INDEX) for n in INDEXED)]:
            if not self._has(name):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}.parquet")
                made.append(name)
        return made

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put the rows in place of a table, which they may read."""
        fresh, old = self._path(f"{name}.new"), self._path(f"{name}.parquet")
        self._files.delete(fresh, True)
        rows.write.parquet(f"{self.folder}/{name}.new")
        self._files.delete(old, True)
        if not self._files.rename(fresh, old):
            raise OSError(f"{name} could not be put in place")

    def change(self, name: str, updates: DataFrame) -> int:
        """Upsert rows into a table and its index; gives the number of distinct keys that came."""
        updates = materialize(store.latest(updates, KEYS[name], []), "updates")
        now = store.upsert(self.table(name), updates, KEYS[name], store.UPDATED[name]).select(*self.table(name).columns)
        now = materialize(now, "state")
        self.replace(name, now)
        if name in INDEXED:
            self.index(name, now.join(updates.select("id"), "id", "left_semi"))
        return updates.count()

    def index(self, name: str, changed: DataFrame) -> None:
        """Renew the postings of the changed rows; the others are kept."""
        kept = self.table(f"index_{name}").join(changed.select("id"), "id", "left_anti")
        self.replace(f"index_{name}", kept.unionByName(search.postings(changed, "id", INDEXED[name])))

    def delete(self, name: str, gone: DataFrame) -> None:
        """Take the rows of the given ids out of a table and its index; of a repository also all that belongs to it."""
        gone = materialize(gone.select("id").distinct(), "gone")
        if name == "repos":
            for child in ("commits", "issues", "releases", "dependencies", "verdicts"):
                rows = materialize(self.table(child).join(gone.withColumnRenamed("id", "repo_id"), "repo_id", "left_semi"), "children")
                if "id" in rows.columns:
                    self.delete(child, rows)
                else:
                    self.replace(child, store.cascade_delete(self.table(child), gone, "repo_id", "id"))
        self.replace(name, self.table(name).join(gone, "id", "left_anti"))
        if name in INDEXED:
            self.replace(f"index_{name}", self.table(f"index_{name}").join(gone, "id", "left_anti"))

    def match(self, name: str, phrases: list[str]) -> DataFrame:
        """Ids of the rows in whose text one of the phrases stands, by the index."""
        return search.match_postings(self.table(f"index_{name}"), "id", phrases)

    def judge(self, verdicts: DataFrame) -> None:
        """Add verdicts on repositories; an unknown one is an error and changes nothing."""
        bad = verdicts.filter(~F.coalesce(F.col("verdict").isin(list(store.VERDICTS)), F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"no verdict: {bad[0]['verdict']}")
        self.replace("verdicts", materialize(self.table("verdicts").unionByName(verdicts), "verdicts"))

    def sync(self, pages: str, owner: str, now: str, per_page: int = 100, max_pages: int = 10) -> dict[str, int]:
        """Take in the saved pages ``PAGES/KIND/REPO__N.json`` of an owner; gives how many entities of each kind came.

        Kinds without a folder are passed over.  The time of the run is kept for
        the owner; its cursor stays as it is.
        """
        self.init()
        made: dict[str, int] = {}
        for kind in ("repos", "commits", "issues", "releases"):
            folder = self._jvm.org.apache.hadoop.fs.Path(f"{pages}/{kind}")
            if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
                made[kind] = 0
                continue
            items = payloads.read_pages(self.spark, f"{pages}/{kind}", kind, per_page, max_pages)
            read = {"repos": lambda x: payloads.repos(x, now), "commits": lambda x: payloads.commits(x, owner), "issues": payloads.issues, "releases": payloads.releases}[kind]
            made[kind] = self.change(kind, read(items))
        done = self.spark.createDataFrame([(f"repos:{owner}", now, None)], TABLES["sync_state"])
        self.replace("sync_state", materialize(store.upsert_cursor(self.table("sync_state"), done), "synced"))
        return made

    def drop(self) -> None:
        """Remove the store's tables and indexes."""
        for name in [*TABLES, *(f"index_{n}" for n in INDEXED)]:
            remove(self.spark, f"{self.folder}/{name}.parquet")
