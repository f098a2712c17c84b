"""Intermediate results that outlive the executors that made them.

A result used several times is written as a Parquet table below the folder in
``spark.checkpoint.dir``, which a cluster's executors share. Only a local session
without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session, else one of our own for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="termloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        pass  # the session has ended; the folder's owner clears it


@atexit.register
def clear() -> None:
    """Deletes every table made so far. A long session calls this once the results built on them are written."""
    while _made:
        _delete(*_made.pop())


def durable(df: DataFrame) -> DataFrame:
    """Run ``df`` once, write it to the shared folder and read it from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/termloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for the caller's files; it goes when the tables go."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def measures_small(df: DataFrame, limit: int = 16_000_000) -> bool:
    """Whether ``df`` has at most ``limit`` bytes (strings, and 40 bytes a row). It is read once for that, so it should be a durable one."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    each = F.lit(40)
    for s in strings:
        each = each + s
    return (df.agg(F.sum(each.cast("bigint"))).first()[0] or 0) <= limit


def if_small(df: DataFrame, limit: int = 16_000_000) -> DataFrame:
    """``df`` marked for broadcast if it measures small, else as it is, to be joined by exchange."""
    return F.broadcast(df) if measures_small(df, limit) else df
