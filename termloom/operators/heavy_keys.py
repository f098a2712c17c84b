"""Per-key results when a few keys hold most of the rows.

Heavy keys come from a bounded sample and only choose the route of a row, never the
result: a key the sample misses takes the ordinary route and is counted exactly there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows the detection sample has on average, and the share of it that makes a key heavy.
#: A share s leaves at most 1 / s keys, so the broadcast side has at most 200 rows.
SAMPLE_ROWS = 200_000
HEAVY_SHARE = 0.005


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    """The keys with at least ``share`` of a sampled ``df``: one column ``key``.

    The sample is drawn by row, so the cost is one narrow scan; the answer has at most
    ``1 / share`` rows at any input size. Null keys are never heavy. An empty input has none.
    """
    total = df.count()
    fraction = min(1.0, sample_rows / max(total, 1))
    drawn = df.select(F.col(key).alias("_k")).where("_k IS NOT NULL")
    if fraction < 1.0:
        drawn = drawn.sample(fraction=fraction, seed=seed)
    counts = drawn.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    floor = max(2.0, share * fraction * total)
    rows = counts.where(F.col("_n") >= floor).select("_k").limit(int(1 / share) + 1).collect()
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], df.select(key).schema)


def key_statistics(df: DataFrame, key: str, item: str, weight: str, share: float = HEAVY_SHARE) -> DataFrame:
    """For each key: ``n_rows``, ``n_items`` (distinct non-empty items) and ``sum_weight``.

    Rows of heavy keys are picked by a broadcast join against at most ``1 / share`` keys and
    aggregated by (key, item) first, so map-side combining shrinks them and the exchange spreads
    one key over all tasks. The other rows take one ordinary exchange by key; both aggregations
    above it reuse that partitioning. Every task's load is then bounded by the light keys' share.

    A null key is a key of its own. Null and empty items add to ``n_rows`` only; null weights
    add nothing (a key with only null weights sums to 0). Repeated rows count as rows.
    """
    rows = df.select(F.col(key).alias("_k"), F.when(F.length(item) > 0, F.col(item)).alias("_i"), F.col(weight).cast("bigint").alias("_w"))
    heavy = F.broadcast(heavy_keys(df, key, share).toDF("_k"))
    of_heavy = _by_key(rows.join(heavy, "_k", "left_semi"))
    of_light = _by_key(rows.join(heavy, "_k", "left_anti").repartition(F.col("_k")))
    return of_heavy.unionByName(of_light).withColumnRenamed("_k", key)


def _by_key(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("_k", "_i").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
    return each.groupBy("_k").agg(F.sum("_n").alias("n_rows"), F.count("_i").alias("n_items"), F.coalesce(F.sum("_w"), F.lit(0)).alias("sum_weight"))
