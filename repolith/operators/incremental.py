"""Runs that process only what is new, surviving failures.

Two parts.  ``pending`` decides which entities a run has to bring out, from the
rows seen so far and the watermark of the last successful run.  ``Runs`` carries
out runs over a source with a monotonic commit sequence: the upper limit is fixed
when a run starts, and the output becomes visible in the same atomic step that
moves the watermark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.time import instant


def watermarks(state: DataFrame, prefix: str) -> DataFrame:
    """The current watermark of each entity ``prefix:NAME``.

    Of several rows the latest instant counts; on a tie the greatest cursor
    (a missing cursor least).  A cursor that cannot be read stands before every
    row: repeating work is safe, skipping it is not.
    """
    at = instant("last_synced_at")
    kept = (
        state.filter(F.col("entity").startswith(prefix))
        .select(F.substring("entity", len(prefix) + 1, 1 << 30).alias("owner"), at.alias("synced"), "cursor")
        .filter("synced is not null")
        .groupBy("owner")
        .agg(F.max(F.struct("synced", "cursor")).alias("w"))
        .select("owner", "w.*")
    )
    decoded = F.try_to_binary("cursor", F.lit("base64")).cast("string")
    text = F.when(F.col("cursor").contains("|"), F.col("cursor")).when(decoded.contains("|"), decoded)
    return (
        kept.withColumn("text", text)
        .select(
            "owner",
            "synced",
            F.col("cursor").isNull().alias("complete"),
            instant(F.substring_index("text", "|", 1)).alias("cursor_at"),
            F.expr("substr(text, instr(text, '|') + 1)").alias("cursor_id"),
        )
    )


def pending(
    df: DataFrame,
    marks: DataFrame,
    key: str,
    owner: Column,
    changed: Column,
    arrived: Column,
    attributes: dict[str, Column],
    upto: Column | None = None,
) -> DataFrame:
    """Keys that are new, or whose state differs from the state already processed.

    A row is processed if its owner has a watermark, it arrived no later than
    that run, and the run got past it: there is no cursor or (changed, key) is
    not greater than the cursor's pair.  A state is the row with the latest
    ``changed``, then ``arrived``, then the greatest attributes; an unreadable
    instant is the earliest.  Rows that arrived after ``upto`` (fixed by the
    caller when the run starts) wait for the next run; rows whose arrival is
    unknown are never taken as processed.  Rows without a key are left out.

    Cost: a join with one row per owner and one aggregation per key with a
    partial step before the shuffle, so no key's rows are gathered.
    """
    rows = df.select(
        F.col(key).alias("key"),
        owner.alias("owner"),
        changed.alias("changed"),
        arrived.alias("arrived"),
        F.struct(*(c.alias(n) for n, c in attributes.items())).alias("state"),
    ).filter(F.col("key").isNotNull())
    if upto is not None:
        rows = rows.filter(F.col("arrived").isNull() | (F.col("arrived") <= upto))
    pair = F.struct(F.col("changed"), F.col("key"))
    past = F.col("complete") | (pair <= F.struct(F.col("cursor_at").alias("changed"), F.col("cursor_id").alias("key")))
    done = F.coalesce((F.col("arrived") <= F.col("synced")) & past & F.col("synced").isNotNull(), F.lit(False))
    rank = F.struct("changed", "arrived", "state")
    return (
        rows.join(marks, "owner", "left")
        .select("key", rank.alias("rank"), done.alias("done"))
        .groupBy("key")
        .agg(F.max("rank").alias("now"), F.max(F.when(F.col("done"), F.col("rank"))).alias("before"))
        .filter(F.col("before").isNull() | ~F.col("now")["state"].eqNullSafe(F.col("before")["state"]))
        .select(F.col("key").alias(key))
    )


class Runs:
    """Runs over a source with a monotonic commit sequence, exactly once each.

    ``root`` is a folder on storage that all machines share, in any file system
    that the session knows.  A run reads the watermark of the last commit, fixes
    its upper limit, writes its output into a folder of its own and then
    publishes one small file that names output and watermark together.
    Publishing is a rename that fails if the name is taken, so of two concurrent
    runs one loses and changes nothing.  A run that dies before that leaves only
    a folder that no reader looks at, and that ``sweep`` removes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)
        for folder in ("commits", "output"):
            self._files.mkdirs(self._path(f"{self.root}/{folder}"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/{folder}")))

    def _numbers(self) -> list[str]:
        return [n for n in self._names("commits") if n.endswith(".json") and not n.startswith(".")]

    def _commit(self, name: str) -> dict:
        stream = self._files.open(self._path(f"{self.root}/commits/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """The commits so far, in order (one small file each)."""
        return [self._commit(n) for n in self._numbers()]

    def last(self) -> dict | None:
        """The last commit; only its file is read."""
        names = self._numbers()
        return self._commit(names[-1]) if names else None

    def _publish(self, number: int, commit: dict) -> None:
        staged = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        stream = self._files.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(commit).encode()))
            stream.hsync()
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
        try:
            context.rename(staged, self._path(f"{self.root}/commits/{number:012d}.json"), options)  # does not overwrite
        except Exception as e:
            self._files.delete(staged, False)
            raise FileExistsError(f"another run has published commit {number}") from e

    def run(
        self,
        source: DataFrame,
        sequence: str,
        work: Callable[[DataFrame, DataFrame], DataFrame],
        before_commit: Callable[[], None] | None = None,
        unplaced: bool = False,
    ) -> dict | None:
        """Process the rows with watermark < ``sequence`` <= the limit fixed now.

        ``work`` gets these rows, and all rows up to the limit for work that
        compares with what was known before; it gives the output.  Rows that
        come while the run is on its way wait for the next one.  Gives the
        commit, or None where nothing is new.

        A row that turns up at or below the watermark later than the run that
        set it, and a row whose sequence is null, have no place in the sequence:
        both raise an error instead of being skipped.  With ``unplaced`` rows of
        null sequence are part of every run instead, for work that may repeat.
        """
        number = len(self._numbers())
        past = self.last()
        low = past["watermark"] if past else None
        kind = source.schema[sequence].dataType
        at = F.col(sequence)
        before = F.count_if(at <= F.lit(low).cast(kind)) if past else F.lit(0).cast("long")
        bounds = source.agg(F.max(at).cast("string").alias("high"), F.count_if(at.isNull()).alias("lost"), F.count(at).alias("rows"), before.alias("before")).first()
        if bounds["lost"] and not unplaced:
            raise ValueError(f"{bounds['lost']} rows without {sequence}")
        if past and bounds["before"] != past["rows"]:
            raise ValueError(f"{bounds['before'] - past['rows']} rows came behind the watermark {low}")
        high = bounds["high"]
        if high is None and not (unplaced and bounds["lost"]) or high == low and past:
            return None
        limit = at <= F.lit(high).cast(kind)
        until = source.filter(at.isNull() | limit) if unplaced else source.filter(limit)
        new = until.filter(at.isNull() | (at > F.lit(low).cast(kind))) if past else until
        output = f"output/{uuid.uuid4().hex}"
        work(new, until).write.parquet(f"{self.root}/{output}")
        if before_commit:
            before_commit()
        commit = {"number": number, "low": low, "watermark": high, "rows": bounds["rows"], "output": output}
        self._publish(number, commit)
        return commit

    def sweep(self) -> int:
        """Remove outputs and staged files of runs that died, and give their number.  Not while a run is on its way."""
        named = {c["output"].rpartition("/")[2] for c in self.commits()}
        dead = [f"output/{n}" for n in self._names("output") if n not in named] + [f"commits/{n}" for n in self._names("commits") if n.startswith(".")]
        for name in dead:
            self._files.delete(self._path(f"{self.root}/{name}"), True)
        return len(dead)

    def read(self) -> DataFrame | None:
        """Everything committed so far; None before the first commit."""
        outputs = [f"{self.root}/{c['output']}" for c in self.commits()]
        return self.spark.read.parquet(*outputs) if outputs else None
