"""The state of an append-only posting table, its term counts and its term-record associations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.durable import durable, if_small
from termloom.operators.heavy_keys import heavy_keys

ROWS_A_PART = 500_000
#: A term is heavy from this share of a sampled table on: at most 1 / share terms are broadcast, and counted in arrays of that length.
HEAVY_TERM_SHARE = 0.001


def latest_tf(postings: DataFrame, term: str = "term", url: str = "url", tf: str = "tf", at: str = "indexedAt") -> DataFrame:
    """(term, url, tf): the state with the latest ``at`` for each term and url.

    Rows with a null or empty term or a null url are left out; a null tf counts as 1; a null ``at`` is older
    than any other. Of several states at the same time the greatest tf wins. Rows of the urls that hold much of
    the table are combined map-side and exchanged by (url, term), the others are exchanged by url alone, where a
    page's rows lie together and compress. The state is written once for its several readers.
    """
    rows = postings.where((F.length(term) > 0) & F.col(url).isNotNull())
    value = F.coalesce(F.col(tf).cast("bigint"), F.lit(1).cast("bigint"))
    rows = rows.select(F.col(term).alias("term"), F.col(url).alias("url"), value.alias("tf"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    first, last, least, most, n = rows.agg(F.min("at"), F.max("at"), F.min("tf"), F.max("tf"), F.count(F.lit(1))).first()
    tf_bits = ((most or 0) - (least or 0)).bit_length()
    packed = ((last or 0) - (first or 0) + 1).bit_length() + tf_bits <= 62
    latest = (lambda r: _last_packed(r, first or 0, least or 0, tf_bits)) if packed else _last
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_PART)
    heavy = F.broadcast(heavy_keys(postings, url).select(F.col(url).alias("url")))
    return durable(latest(rows.join(heavy, "url", "left_semi")).unionByName(latest(rows.join(heavy, "url", "left_anti").repartition(parts, "url"))))


def _last_packed(rows: DataFrame, first: int, least: int, tf_bits: int) -> DataFrame:
    """Time above, tf below, in one number: its maximum is the state, and the aggregation keeps one fixed-width buffer."""
    moment = F.coalesce(F.col("at") - F.lit(first).cast("bigint") + 1, F.lit(0).cast("bigint"))
    order = F.shiftleft(moment, tf_bits) + (F.col("tf") - F.lit(least).cast("bigint"))
    state = rows.select("url", "term", order.alias("o")).groupBy("url", "term").agg(F.max("o").alias("o"))
    return state.select("url", "term", (F.col("o").bitwiseAND(F.lit((1 << tf_bits) - 1).cast("bigint")) + F.lit(least).cast("bigint")).alias("tf"))


def _last(rows: DataFrame) -> DataFrame:
    """For times and tf too far apart for one number: by time, then over the times."""
    moment = F.coalesce("at", F.lit(-(2**63)).cast("bigint"))
    by_time = rows.select("url", "term", "tf", moment.alias("o")).groupBy("url", "term", "o").agg(F.max("tf").alias("tf"))
    return by_time.groupBy("url", "term").agg(F.max_by("tf", "o").alias("tf"))


def _local_counts(size: int):
    """Counts heavy terms of a task in two arrays and puts them out once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy()
            rows += np.bincount(at, minlength=size)
            np.add.at(total, at, batch.column(1).to_numpy())
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), pa.array(rows[used])], names=["at", "total", "records"])

    return count


def value_counts(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, total, records): the sum of ``weight`` and the number of rows of each value, by a heavy-light split.

    Heavy values, at most ``1 / HEAVY_TERM_SHARE`` by a bounded sample, are broadcast with a position; each task
    adds their rows into arrays and puts out one row for each. Only the other values' rows are shuffled. The
    sample decides the route, both routes are exact. Null values are left out, null weights add nothing.
    """
    rows = rows.where(F.col(value).isNotNull())
    heavy = [r[0] for r in heavy_keys(rows, value, HEAVY_TERM_SHARE).collect()]
    table = rows.sparkSession.createDataFrame(list(enumerate(heavy)), "at int, value string")
    marked = rows.select(F.col(value).alias("value"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("w")).join(F.broadcast(table), "value", "left")
    local = marked.where("at IS NOT NULL").select("at", "w").mapInArrow(_local_counts(len(heavy)), "at int, total long, records long")
    of_heavy = local.groupBy("at").agg(F.sum("total").alias("total"), F.sum("records").alias("records")).join(F.broadcast(table), "at").select("value", "total", "records")
    of_light = marked.where("at IS NULL").groupBy("value").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("records"))
    return of_heavy.unionByName(of_light)


def usefulness(records: Column, all_records: Column, rare: int, common: float) -> Column:
    """``rare`` up to that many records, ``common`` from that share of all records on, else ``useful``."""
    return F.when(records <= rare, "rare").when(records >= F.lit(common) * all_records, "common").otherwise("useful")


def term_marks(state: DataFrame, rare: int, common: float) -> DataFrame:
    """(term, total, records, mark) over a (term, url, tf) state; a term that is rare and common at once is rare."""
    urls = F.lit(state.select("url").distinct().count())
    counts = value_counts(state, "term", "tf").withColumnRenamed("value", "term")
    return counts.select("term", "total", "records", usefulness(F.col("records"), urls, rare, common).alias("mark"))


def association(state: DataFrame, exponent: float = 0.75) -> DataFrame:
    """(url, term, tf, records, pmi, ppmi) over a (term, url, tf) state; pmi is the score before negative ones become 0, null for a tf of 0.

    ppmi = max(0, ln(p(term, url) / (p(term) * p'(url)))), p' being the urls' shares after raising their counts
    to ``exponent``, which keeps small records from inflating every score. records counts the urls of the term.
    The state stays where it is as long as the marginal tables measure as small enough to be broadcast. No tf stops it:
    counts are added as doubles, and where those of a term or url cancel out pmi is null.
    """
    count = F.sum(F.col("tf").cast("double"))
    terms = durable(state.groupBy("term").agg(count.alias("of_term"), F.count(F.lit(1)).alias("records")))
    urls = durable(state.groupBy("url").agg(count.alias("of_url")))
    smooth = F.lit(urls.agg(F.coalesce(F.sum(F.pow("of_url", F.lit(exponent))), F.lit(0.0))).first()[0])
    both = state.select("url", "term", "tf").join(if_small(terms), "term").join(if_small(urls), "url")
    ratio = F.try_divide(F.col("tf") * smooth, F.col("of_term") * F.pow("of_url", F.lit(exponent)))
    scored = both.select("url", "term", "tf", "records", F.when(F.col("tf") > 0, F.log(ratio)).alias("pmi"))
    return scored.withColumn("ppmi", F.coalesce(F.greatest(F.lit(0.0), F.col("pmi")), F.lit(0.0)))


def text_terms(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, url, tf) of the words of each key's text, once for each key; ``words`` is a string with one blank between words."""
    pages = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("url"), words.alias("words")).dropDuplicates(["url"])
    each = pages.select("url", F.explode(F.split("words", " ")).alias("term")).where(F.length("term") > 0)
    return durable(each.groupBy("url", "term").agg(F.count(F.lit(1)).alias("tf")))
