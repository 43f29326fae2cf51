"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cpus: int | str = "*", app: str = "tallyline", **extra: str) -> SparkSession:
    """A session on ``local[cpus]`` for tests, benches and the command line."""
    conf = LOCAL_DEFAULTS | extra
    session = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
