"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "termloom") -> SparkSession:
    """A session on this machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config(map=SETTINGS).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()
