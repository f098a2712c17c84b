"""Drawing records from sources so that each contributes a target share of the total size.

Records of a source are ordered by a hash of their key. Sizes are summed by source and hash bucket,
which gives for every source the bucket in which its budget ends; only that bucket is summed again by
finer hash buckets, and only the last of those is ordered record by record. Everything else is chosen
by comparing hashes with a threshold: no sort. Thresholds of several budgets are found in the same
histograms, and the draw for a smaller budget lies within that for a larger one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.durable import measures_small

BITS = 12  # 4 096 buckets for each source, and as many again for each boundary bucket


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def targets_of(targets: DataFrame, source: str, weight: str, repeats: str) -> DataFrame:
    """(name, source, share, repeats) for each source; notations of one name are merged, weights not above 0 left out."""
    rows = targets.select(source_name(F.col(source)).alias("name"), F.col(source).alias("source"), F.col(weight).cast("double").alias("w"), F.greatest(F.lit(0), F.coalesce(F.col(repeats).cast("int"), F.lit(1))).alias("repeats"))
    rows = rows.where("name IS NOT NULL AND w > 0").groupBy("name").agg(F.min("source").alias("source"), F.sum("w").alias("w"), F.max("repeats").alias("repeats"))
    return rows.withColumn("share", F.col("w") / rows.agg(F.sum("w")).scalar()).select("name", "source", "share", "repeats")


def _size(column: str = "size") -> Column:
    """A null or negative size counts as 0."""
    return F.greatest(F.coalesce(F.col(column), F.lit(0)), F.lit(0))


def budgets(sized: DataFrame, targets: DataFrame, totals: Sequence[float | None] = (None,)) -> DataFrame:
    """For each budget and source: tokens there are, target, whole passes over its records and the size still to be drawn.

    ``sized`` is (key, name, size). Each of ``totals`` is a budget, numbered from 0; None is the size of all records of
    listed sources. A source whose target exceeds its size times its repeats gets every repeat.
    """
    have = sized.groupBy("name").agg(F.sum(_size()).alias("have"))
    rows = targets.join(have, "name", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    total = rows.agg(F.sum("have")).first()[0] or 0
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("budget"), F.lit(float(total if t is None else t)).alias("total")) for i, t in enumerate(totals)]))
    rows = rows.withColumn("_b", each).select("*", "_b.budget", "_b.total").drop("_b")
    target = F.col("share") * F.col("total")
    most = F.col("have") * F.col("repeats")
    passes = F.when(target > most, F.col("repeats")).when(F.col("have") > 0, F.floor(target / F.col("have")).cast("int")).otherwise(0)
    rows = rows.withColumn("target", target).withColumn("passes", passes)
    return rows.withColumn("rest", F.when(target > most, F.lit(0.0)).otherwise(F.col("target") - F.col("passes") * F.col("have")))


def order_hash(key: Column) -> Column:
    """60 bits of the key's MD5, by which a source's records are ordered."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def _boundary(histogram: DataFrame, bucket: str, rest: str) -> DataFrame:
    """(name, budget, bucket, left): the first bucket in which the running sum exceeds ``rest``, and what is left for it."""
    w = Window.partitionBy("name", "budget").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = histogram.withColumn("run", F.sum("size").over(w)).where(F.col("run") > F.col(rest))
    first = run.groupBy("name", "budget").agg(F.min(F.struct(F.col(bucket), (F.col(rest) - F.col("run") + F.col("size")).alias("left"))).alias("m"))
    return first.select("name", "budget", F.col(f"m.{bucket}").alias(bucket), F.col("m.left").alias("left"))


def mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, name, size, budget, uses) for each record of a listed source and each budget; ``plan`` comes from ``budgets``.

    What is drawn of a source differs from its target by at most half of the record at the boundary, unless its records
    at all their repeats don't reach it. Rows with equal keys are drawn together, as one record of their summed size. A
    null or negative size counts as 0. What goes to every task has a row for each listed source, if that measures small.
    """
    small: Callable[[DataFrame], DataFrame] = F.broadcast if measures_small(plan) else lambda df: df
    mask = (1 << BITS) - 1
    h = order_hash(F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = sized.select("key", "name", _size().alias("size"), h.alias("h"))
    rows = rows.withColumn("c1", F.shiftrightunsigned("h", 60 - BITS)).withColumn("c2", F.shiftrightunsigned("h", 60 - 2 * BITS).bitwiseAND(F.lit(mask)))
    need = plan.select("name", "budget", "rest", "passes")
    one = rows.groupBy("name", "c1").agg(F.sum("size").alias("size")).join(small(need), "name")
    b1 = _boundary(one, "c1", "rest").withColumnsRenamed({"c1": "b1", "left": "left1"})
    inside = rows.join(small(b1), "name").where("c1 = b1")
    two = inside.groupBy("name", "budget", "c2", "left1").agg(F.sum("size").alias("size"))
    b2 = _boundary(two, "c2", "left1").withColumnsRenamed({"c2": "b2", "left": "left2"})
    last = inside.join(small(b2), ["name", "budget"]).where("c2 = b2").groupBy("name", "budget", "left2", "h", "key").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("name", "budget").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = last.withColumn("run", F.sum("size").over(w)).where(F.col("run") - F.col("size") / 2 <= F.col("left2"))
    top = drawn.groupBy("name", "budget").agg(F.max(F.struct("h", "key")).alias("upto"))
    marks = need.join(b1, ["name", "budget"], "left").join(b2, ["name", "budget"], "left").join(top, ["name", "budget"], "left")
    first = F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("b1").isNull(), F.lit(True)).when(F.col("c1") != F.col("b1"), F.col("c1") < F.col("b1"))
    within = F.when(F.col("b2").isNull(), F.lit(True)).when(F.col("c2") != F.col("b2"), F.col("c2") < F.col("b2")).otherwise(F.coalesce(F.struct("h", "key") <= F.col("upto"), F.lit(False)))
    chosen = first.otherwise(within)
    return rows.join(small(marks), "name").select("key", "name", "size", "budget", (F.col("passes") + chosen.cast("int")).alias("uses"))


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each budget and listed source with its target and actual share of what was drawn.

    ``short`` marks what the draw shows: every record is used as often as it may be, and still less than the target is drawn.
    """
    sums = mixed.groupBy("name", "budget").agg(F.sum(F.col("size") * F.col("uses")).alias("drawn"), F.sum("uses").alias("n_uses"), F.min("uses").alias("least"))
    rows = plan.join(sums, ["name", "budget"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    all_drawn = rows.groupBy("budget").agg(F.sum("drawn").cast("double").alias("all_drawn"))
    short = (F.coalesce("least", "repeats") >= F.col("repeats")) & (F.col("drawn") < F.col("target"))
    actual = F.coalesce(F.col("drawn") / F.nullif("all_drawn", F.lit(0.0)), F.lit(0.0))
    return rows.join(all_drawn, "budget").select("budget", "source", F.col("share").alias("target_share"), F.col("have").alias("tokens"), "repeats", "target", "drawn", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), actual.alias("actual_share"), short.alias("short"))
