"""Queries over keys of very unlike sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import heavy_keys
from termloom.tables import load


def p3_url_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = heavy_keys.key_statistics(load(spark, sf_dir, "postings"), "url", "term", "tf")
    return stats.toDF("url", "n_rows", "n_terms", "sum_tf")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "postings")
    stats = heavy_keys.key_statistics(rows, "url", "term", "tf")
    return stats.where(F.col("url").isNotNull() & (F.col("n_rows") >= F.lit(0.02 * rows.count()))).select("url")


QUERIES = {"p3_found": p3_found, "p3_url_stats": p3_url_stats}

ORACLES = {
    "p3_found": "SELECT url FROM postings WHERE url IS NOT NULL GROUP BY url HAVING count(*) >= 0.02 * (SELECT count(*) FROM postings)",
    "p3_url_stats": """
SELECT url, count(*) AS n_rows, count(DISTINCT CASE WHEN term <> '' THEN term END) AS n_terms,
       CAST(coalesce(sum(tf), 0) AS BIGINT) AS sum_tf
FROM postings GROUP BY url
""",
}
