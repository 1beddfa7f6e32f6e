"""Session factory and the settings every query relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that decide results, not speed.  They may be set on a running session.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

#: Defaults for sessions that we create ourselves; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "repolith", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with our defaults; ``cores`` sizes a local master and its shuffles."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.appName(app).master(master or f"local[{n}]")
    settings = {**DEFAULTS, **REQUIRED, "spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin(spark: SparkSession) -> SparkSession:
    """Set what results depend on; called by every query before it builds its plan."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k) != v:
            spark.conf.set(k, v)
    return spark
