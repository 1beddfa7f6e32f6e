"""Streaming forms of the history operators: windows over late events, and upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repolith.operators.store import latest, upsert
from repolith.storage import new_folder, remove


def source(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed(events: DataFrame, at: str, by: list[str], value: str, window: str = "1 week", start: str = "4 days", late: str = "2 days") -> DataFrame:
    """Events and sum of a value by window of event time; what comes later than ``late`` is too late.

    The default windows are ISO weeks: the epoch was a Thursday, so they start four days after it.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    made = timed.groupBy(F.window("_at", window, window, start).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), *by, "n", "total")


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all that is there and give the result; state and output are in the shared folder."""
    spark = stream.sparkSession
    root = new_folder(spark, label)
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{root}/out/epoch={last}")


def upsert_stream(updates: DataFrame, root: str, keys: list[str], updated: list[str], order: list[str]) -> None:
    """Apply a stream of updates to a state table under ``root``, one version for each batch.

    A batch that is run again writes its own version again from the version
    before, so that nothing is applied twice; the one before that is removed.
    """
    spark = updates.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        one = latest(batch, keys, [F.col(c) for c in order])
        now = one if epoch == 0 else upsert(spark.read.parquet(f"{root}/version={epoch - 1}"), one, keys, updated)
        now.write.mode("overwrite").parquet(f"{root}/version={epoch}")
        if epoch > 1:
            remove(spark, f"{root}/version={epoch - 2}")

    updates.writeStream.option("checkpointLocation", f"{root}/_state").foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()
