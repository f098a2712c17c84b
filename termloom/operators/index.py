"""Building and reading the inverted index.

The index is a table of postings (term, url, tf, page metadata), sorted by term within its files, so
a term is found by the files' statistics. The nested form, one row a term, is a view of it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import stemmed, term_counts

FLAGS = ("isFork", "isArchived", "lowContent")


def pages(docs: DataFrame) -> DataFrame:
    """One row for each doc_key, the one fetched last, with defaults for missing metadata."""
    kept = docs.where(F.col("doc_key").isNotNull())
    cols = ["text", "repoOwner", "topics", *FLAGS, "lastCommitDate"]
    top = kept.groupBy("doc_key").agg(F.max(F.struct("fetchedAt", *cols)).alias("m")).select("doc_key", *[f"m.{c}" for c in cols])
    return with_defaults(top)


def with_defaults(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("repoOwner", F.coalesce("repoOwner", F.lit(""))).withColumn("lastCommitDate", F.coalesce("lastCommitDate", F.lit("")))
    rows = rows.withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    for flag in FLAGS:
        rows = rows.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return rows


def postings(docs: DataFrame, stop: Iterable[str] | None = None) -> DataFrame:
    """One posting for each page and distinct term. Metadata belong to the page and are joined to its counts, not counted with."""
    page = pages(docs)
    counts = term_counts(page.select("doc_key", "text"), "doc_key", "text", stop)
    return counts.join(page.drop("text"), "doc_key").withColumnRenamed("doc_key", "url")


META = ("repoOwner", "topics", *FLAGS, "lastCommitDate")


def current_postings(log: DataFrame, terms: DataFrame | None = None, meta: tuple[str, ...] | None = None, combine: bool = False) -> DataFrame:
    """The latest state of each (term, url) of an append-only posting table; a null or zero tf is 1.

    With ``terms`` (term), only their postings: the log is narrowed before its states are compared. An empty ``meta``
    leaves the metadata out: of the states of one moment the one with the greatest tf counts, whatever its metadata.
    With ``combine`` states are compared before they move as well.
    """
    kept = log.where((F.length("term") > 0) & F.col("url").isNotNull())
    kept = with_defaults(kept if terms is None else kept.join(terms.select("term").distinct(), "term", "left_semi"))
    cols = ["tf", *(META if meta is None else meta)]
    rows = kept.withColumn("tf", F.coalesce(F.nullif("tf", F.lit(0)), F.lit(1)).cast("bigint"))
    # the states are compared where they lie together: combining such wide rows before they move would sort them twice
    top = (rows if combine else rows.repartition("term", "url")).groupBy("term", "url").agg(F.max(F.struct("indexedAt", *cols)).alias("m"))
    return top.select("term", "url", *[f"m.{c}" for c in cols])


def inverted(index: DataFrame) -> DataFrame:
    """term and its postings in the order of url. For reading terms; a term's list is as long as its document frequency."""
    fields = [c for c in index.columns if c not in ("term", "url")]
    return index.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("url", *fields))).alias("postings"))


def doc_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lookup(index: DataFrame, term: str) -> DataFrame:
    """A term's postings; the filter reaches the Parquet scan."""
    return index.where(F.col("term") == term)


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("term").alias("termCount"))


def write(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes range-partitioned and sorted by term, so that a term lies in few files and row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term", "url").write.mode(mode).parquet(path)


def merge(index: DataFrame, new: DataFrame) -> DataFrame:
    """Terms of ``new`` replace the same terms' postings, others stay."""
    return index.join(new.select("term").distinct(), "term", "left_anti").unionByName(new)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_indexer(docs: DataFrame, path: str, stop: Iterable[str] | None = None) -> dict[str, int]:
    """Builds and writes the index; counts terms, and pages, those with no term included."""
    write(postings(docs, stop), path)
    spark = docs.sparkSession
    return {"terms": index_stats(read(spark, path)).first()[0], "docs": docs.select("doc_key").distinct().count()}
