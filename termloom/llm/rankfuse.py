"""One ranking from several scores on unlike scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.durable import durable
from termloom.llm.ranks import ROWS_A_PART, row_ranks


# fixed values: the published coefficients of the approximation
QUANTILE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), by Acklam's rational approximation (relative error below 1.2e-9)."""
    a, b, c, d = QUANTILE

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out: Column = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    middle = poly(a, q * q) * q / poly(b, q * q)
    return F.when(p < 0.02425, poly(c, low) / poly(d, low)).when(p > 1 - 0.02425, -poly(c, high) / poly(d, high)).otherwise(middle)


def latest(rows: DataFrame, group: str, item: str, scores: list[str], at: str) -> DataFrame:
    """The row with the latest ``at`` for each (group, item); of several, the one greatest in the scores. Null keys are left out; a null ``at`` is oldest."""
    kept = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    state = kept.groupBy(group, item).agg(F.max(F.struct(F.col(at).alias("at"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])).alias("m"))
    return state.select(group, item, *[F.col(f"m.s{i}").alias(s) for i, s in enumerate(scores)])


def fused_ranking(rows: DataFrame, group: str, item: str, scores: list[str], at: str, weights: list[float] | None = None) -> DataFrame:
    """(group, item, fused, position, greater_<score>...): one ranking for each group.

    Each score becomes its percentile (r - 1/2) / n in its group, r being the rank with ties averaged, then the
    normal quantile of that, so only the order within a score counts, not its range. ``fused`` is the weighted mean,
    ``position`` 1 for the greatest, ties in the order of item. A null score ranks below all others. greater_<score>
    counts the items of the group with a strictly greater value.
    """
    weights = weights or [1.0] * len(scores)
    now = durable(latest(rows, group, item, scores, at).toDF("_g", "_i", *[f"_s{i}" for i in range(len(scores))]))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), now.count() * len(scores) // ROWS_A_PART)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), (F.col(f"_s{i}") + F.lit(0.0)).alias("v")) for i in range(len(scores))]))
    ranked = row_ranks(now.select("_g", "_i", each.alias("e")).select("_g", "_i", "e.k", "e.v"), ["_g", "k"], ["v"], parts)
    p = (F.col("n_less") + F.col("n_equal") / 2) / F.col("n_total")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") + 1)
    greater = [F.max(F.when(F.col("k") == i, F.col("n_total") - F.col("n_less") - F.col("n_equal"))).alias(f"greater_{s}") for i, s in enumerate(scores)]
    # summed in the order of the scores: a sum in the order of arrival would differ in its last digits from run to run
    part = [F.max(F.when(F.col("k") == i, weight * inverse_normal(p))).alias(f"_z{i}") for i in range(len(scores))]
    total: Column = F.col("_z0")
    for i in range(1, len(scores)):
        total = total + F.col(f"_z{i}")
    fused = ranked.groupBy("_g", "_i").agg(*part, *greater)
    fused = fused.select("_g", "_i", F.round(total / sum(weights), 9).alias("fused"), *[f"greater_{s}" for s in scores])
    fused = durable(fused.withColumn("_down", -F.col("fused")))
    out = row_ranks(fused, ["_g"], ["_down", "_i"], max(1, parts // len(scores)))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), "fused", (F.col("n_less") + 1).alias("position"), *[f"greater_{s}" for s in scores])
