"""Where intermediate results go when a plan has to be cut.

A cut result must survive the loss of executors, so it is written to the shared
folder that the cluster names in ``spark.checkpoint.dir``.  Only where that is
unset, as in tests on one machine, a folder of our own is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, with the session that can remove them.
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master, where none is named, a temporary one.

    A cluster without a named folder is an error: what one machine writes into
    a folder of its own the others cannot read.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="repolith-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder of our own in the shared one, removed with the others by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Later uses read the files and not the plan; column pruning and filters
    still reach them.
    """
    path = new_folder(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(since: int = 0) -> None:
    """Remove what was written after the first ``since`` folders; frames that read them can no longer be used.  Runs when the process ends."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 the session has ended: nothing can be removed any more
            return


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate results of the queries made and read within are removed at its end.

    A session that runs many queries puts each into a scope, so that its disk
    holds the intermediates of one query at a time.
    """
    since = len(_written)
    try:
        yield
    finally:
        release(since)


atexit.register(release)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, for costly work on few and small files.

    A scan of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read lazily so that filters and pruning reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
