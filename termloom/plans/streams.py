"""Stream queries run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.durable import durable, scratch
from termloom.operators import frontier, index
from termloom.streaming import pipelines


def _slices(df: DataFrame, n: int) -> str:
    """The rows as n files or so, the way a stream finds them."""
    path = scratch(df.sparkSession, "stream")
    df.repartition(n).write.parquet(f"{path}/in")
    return path


def s1_stream_index(spark: SparkSession, sf: str) -> DataFrame:
    path = _slices(index.pages(spark.read.parquet(f"{sf}/docs.parquet")).withColumn("fetchedAt", F.lit(0).cast("bigint")), 4)
    pipelines.index_stream(pipelines.source(spark, f"{path}/in", 2), f"{path}/out", f"{path}/state").awaitTermination()
    made = index.current_postings(spark.read.parquet(f"{path}/out"))
    return durable(made.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")))


def s2_stream_frontier(spark: SparkSession, sf: str) -> DataFrame:
    path = _slices(spark.read.parquet(f"{sf}/docs.parquet").select(F.explode("links").alias("url")), 4)
    known = frontier.current(spark.read.parquet(f"{sf}/frontier.parquet")).where("status = 'seen'")
    return _through(pipelines.fresh_urls(pipelines.source(spark, f"{path}/in", 2), known), path).select("url", "status")


def _through(df: DataFrame, path: str) -> DataFrame:
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return durable(df.sparkSession.read.schema(df.schema).parquet(f"{path}/out"))


def s3_stream_gossip(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = _slices(events.unionByName(events.where("event_id % 4 = 0")), 2)
    out = _through(pipelines.delivered(pipelines.source(spark, f"{path}/in", 8), "event_id", "ts", "60 days"), path)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def s4_stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    path = _slices(events, 2)
    return _through(pipelines.rate_limited(pipelines.source(spark, f"{path}/in", 8), "user_id", "arrival", 3_600_000, "event_id"), path)


QUERIES = {f.__name__: f for f in (s1_stream_index, s2_stream_frontier, s3_stream_gossip, s4_stream_rate_limit)}
