"""The engine's operators over streams.

Each pipeline returns a started query over ``availableNow`` or a trigger given by the caller. State
is bounded by watermarks and timeouts, or is the table asked for; tables are changed in ``foreachBatch``, which may run a batch again after a
failure, so every batch writes under its own number and overwrites what an earlier try left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom.functions.urls import normalize_url
from termloom.operators import frontier, index


def source(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """New Parquet files of a folder, a few for each batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def index_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Postings of each batch of pages, one folder a batch, in the form of the posting log; readers take a term's latest state.

    indexedAt is the time a page was fetched at (epoch milliseconds), so a batch that runs again writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = batch.groupBy(F.col("doc_key").alias("url")).agg(F.timestamp_millis(F.coalesce(F.max("fetchedAt"), F.lit(0))).alias("indexedAt"))
        index.postings(batch).join(at, "url").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_urls(urls: DataFrame, known: DataFrame | None = None, now: int = 0) -> DataFrame:
    """Unseen frontier rows for the URLs of a stream that are valid, not in ``known``, and not seen on the stream before.

    The URLs seen are the stream's state, kept by URL where the next batch's rows arrive, so no batch reads earlier
    output again. They are as many as the frontier has: use the RocksDB state store for large ones.
    """
    normal = urls.select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL")
    new = normal if known is None else normal.join(known.select("url").distinct(), "url", "left_anti")
    return new.dropDuplicates(["url"]).select("url", F.lit(frontier.UNSEEN).alias("status"), F.lit(now).cast("bigint").alias("addedAt"))


def delivered(messages: DataFrame, mid: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each message once; ids are forgotten when the watermark has passed them."""
    return messages.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([mid])


def rate_limited(requests: DataFrame, domain: str, arrival: str, interval: int, ident: str, forget_ms: int | None = None) -> DataFrame:
    """(ident, domain, arrival, wait) of a request stream: the last stamp of each domain is its whole state.

    A batch's requests are taken in the order of arrival and ident. With ``forget_ms`` a domain without requests for so
    long by the clock is forgotten: its next request may go, as it would once ``interval`` has passed. That is for streams
    that run on: one with such a timeout has no end, so one over what is available now must do without.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (ident, domain)}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamp = state.get[0] if state.exists else None
        # a batch may come in several frames, each in any order
        rows = sorted((int(t), i) for frame in frames for t, i in zip(frame[arrival], frame[ident]))
        waits = []
        for t, _ in rows:
            wait = 0 if stamp is None or t - stamp >= interval else interval - (t - stamp)
            stamp = t if wait == 0 else stamp
            waits.append(wait)
        state.update((stamp,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({ident: [i for _, i in rows], domain: [key[0]] * len(rows), arrival: [t for t, _ in rows], "wait": waits})

    out = f"`{ident}` {kinds[ident]}, `{domain}` {kinds[domain]}, `{arrival}` bigint, wait bigint"
    return requests.groupBy(domain).applyInPandasWithState(step, out, "stamp bigint", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
