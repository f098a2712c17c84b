"""A key-value collection as a partitioned Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(state: DataFrame, path: str, mode: str = "append") -> None:
    """(gid, key, value) rows, one folder a collection."""
    state.select("gid", "key", "value").write.mode(mode).partitionBy("gid").parquet(path)


def scan(spark: SparkSession, path: str, gid: str) -> DataFrame:
    """A collection's rows; only its folder is read."""
    return spark.read.parquet(path).where(F.col("gid") == gid)


def keys(spark: SparkSession, path: str, gid: str) -> DataFrame:
    return scan(spark, path, gid).select("key").distinct()


def read_value(spark: SparkSession, path: str, gid: str, key: str) -> str:
    row = scan(spark, path, gid).where(F.col("key") == key).select("value").first()
    if row is None:
        raise KeyError(f"Key not found: {key}")
    return row[0]


def reset(spark: SparkSession, path: str, gids: list[str]) -> None:
    """Drops whole collections, keeping the others."""
    jvm = spark.sparkContext._jvm
    for gid in gids:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/gid={gid}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
