"""The crawl frontier: a table of URLs with a status, changed by pure functions from table to table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.urls import normalize_url

UNSEEN, SEEN, ERROR, INVALID = "unseen", "seen", "error", "invalid-url"
STATUSES = (UNSEEN, SEEN, ERROR, INVALID)


def current(log: DataFrame) -> DataFrame:
    """One row for each url of a table with repeated and late rows: the one changed last."""
    last = F.greatest(F.coalesce("addedAt", F.lit(0)), F.coalesce("claimedAt", F.lit(0)), F.coalesce("errorAt", F.lit(0)))
    cols = ["status", "addedAt", "claimedAt", "error", "errorAt"]
    top = log.where(F.col("url").isNotNull()).groupBy("url").agg(F.max(F.struct(last.alias("last"), *cols)).alias("m"))
    return top.select("url", *[f"m.{c}" for c in cols])


def add(frontier: DataFrame, incoming: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each incoming row: url (canonical, or raw if invalid), added, reason.

    A URL is added if it is valid, not in the frontier, and the first of its kind in the batch by ``order``
    (default: by its raw form). The frontier is only joined against; nothing of it is sent to the driver.
    """
    rows = incoming.select(F.col("url").alias("raw"), (order if order is not None else F.col("url")).alias("ord"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("normal", normalize_url(F.col("raw")))
    # the first of a URL is found by partial aggregation; a window would gather all rows of a much repeated one
    first = rows.where("normal IS NOT NULL").groupBy("normal").agg(F.min(F.struct("ord", "raw", "i")).alias("m")).select("normal", F.col("m.i").alias("i0"))
    valid = rows.where("normal IS NOT NULL").join(first, "normal").withColumn("first", F.col("i") == F.col("i0"))
    known = frontier.select(F.col("url").alias("normal"), F.lit(True).alias("known")).distinct()
    judged = valid.join(known, "normal", "left").withColumn("added", F.col("first") & F.col("known").isNull())
    good = judged.select(F.col("normal").alias("url"), "added", F.when(~F.col("added"), "duplicate").alias("reason"))
    bad = rows.where("normal IS NULL").select(F.col("raw").alias("url"), F.lit(False).alias("added"), F.lit(INVALID).alias("reason"))
    return good.unionByName(bad)


def fresh(frontier: DataFrame, incoming: DataFrame) -> DataFrame:
    """(url): the canonical URLs of ``incoming`` that the frontier lacks, each once. Repeats are merged before they move."""
    normal = incoming.select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    return normal.join(frontier.select("url"), "url", "left_anti")


def add_batch(frontier: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many were added and how many skipped, invalid ones included."""
    total = incoming.agg(F.count(F.lit(1)).alias("n")).scalar()
    added = fresh(frontier, incoming).agg(F.count(F.lit(1)).alias("added"))
    return added.select("added", (total - F.col("added")).alias("skipped"))


def with_added(frontier: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """The frontier after ``add``."""
    new = fresh(frontier, incoming).select("url", F.lit(UNSEEN).alias("status"), F.lit(now).cast("bigint").alias("addedAt"))
    return frontier.unionByName(new, allowMissingColumns=True)


def claim(frontier: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """At most ``n`` unseen URLs, drawn by a hash of URL and seed: the same draw wherever it runs."""
    return frontier.where(F.col("status") == UNSEEN).select("url").orderBy(F.sha2(F.concat("url", F.lit(seed)), 256), "url").limit(n)


def with_claimed(frontier: DataFrame, claimed: DataFrame, now: int) -> DataFrame:
    hit = claimed.select("url", F.lit(True).alias("hit"))
    both = frontier.join(hit, "url", "left")
    return both.withColumn("status", F.when(F.col("hit"), SEEN).otherwise(F.col("status"))).withColumn("claimedAt", F.when(F.col("hit"), F.lit(now).cast("bigint")).otherwise(F.col("claimedAt"))).drop("hit")


def mark_error(frontier: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """The frontier after errors (url, reason): unknown URLs become rows, a missing reason is 'unknown'."""
    errors = failed.groupBy("url").agg(F.coalesce(F.max("reason"), F.lit("unknown")).alias("why"))
    both = frontier.join(errors, "url", "full_outer")
    hit = F.col("why").isNotNull()
    return both.select(
        "url", F.when(hit, ERROR).otherwise(F.col("status")).alias("status"), "addedAt", "claimedAt",
        F.when(hit, F.col("why")).otherwise(F.col("error")).alias("error"), F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("errorAt")).alias("errorAt"),
    )


def stats(frontier: DataFrame) -> DataFrame:
    """One row: the count of each stored status and the total."""
    return frontier.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (UNSEEN, SEEN, ERROR)], F.count(F.lit(1)).alias("total"))


def get(frontier: DataFrame, url: str) -> DataFrame:
    return frontier.where(F.col("url") == url)
