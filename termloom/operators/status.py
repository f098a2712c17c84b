"""Counts of the engine's tables, and message delivery."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_metric(rows: DataFrame, node: str, metric: str) -> DataFrame:
    """A metric by node, and summed over the group under the node null."""
    return rows.rollup(node).agg(F.round(F.sum(metric), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def delivered(messages: DataFrame, mid: str) -> DataFrame:
    """Each message once."""
    return messages.dropDuplicates([mid])


def gossip_targets(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(from_nid, to_nid): the max(1, ceil(ln n)) peers each of n nodes passes a message on to, as many as there are at most.

    Nodes stand on a ring in the order of a hash; each draws, by a hash, a place on it where its run of peers begins, and
    never reaches itself. The work is n times the number of peers, and the draw can be repeated.
    """
    n = nodes.count()
    k = min(n - 1, max(1, math.ceil(math.log(n)))) if n > 1 else 0
    ring = nodes.select("nid", (F.row_number().over(Window.orderBy(F.xxhash64("nid", F.lit(seed)), "nid")) - 1).alias("at"))
    start = F.pmod(F.xxhash64("nid", F.lit(seed + 1)), F.lit(max(1, n - 1)))
    step = F.explode(F.array(*[F.lit(j) for j in range(k)]).cast("array<int>")).alias("j")
    drawn = ring.select(F.col("nid").alias("from_nid"), "at", start.alias("start"), step)
    drawn = drawn.select("from_nid", F.pmod(F.col("at") + 1 + F.pmod(F.col("start") + F.col("j"), F.lit(max(1, n - 1))), F.lit(max(1, n))).cast("int").alias("at"))
    return drawn.join(ring.select(F.col("nid").alias("to_nid"), "at"), "at").select("from_nid", "to_nid")


def engine_status(index: DataFrame, docs: DataFrame, frontier: DataFrame) -> DataFrame:
    """One row: terms, documents and the frontier's counts."""
    counts = frontier.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("unseen", "seen", "error")], F.count(F.lit(1)).alias("total"))
    terms = index.where(F.length("term") > 0).agg(F.countDistinct("term").alias("n")).scalar()
    n_docs = docs.agg(F.countDistinct("doc_key").alias("n")).scalar()
    return counts.select(terms.alias("termCount"), n_docs.alias("docs"), "unseen", "seen", "error", "total")


def group_members(log: DataFrame) -> DataFrame:
    """(gid, sid) after a log of membership changes (gid, sid, op, seq); op is add or rem, the last one counts."""
    last = log.groupBy("gid", "sid").agg(F.max(F.struct("seq", "op")).alias("m"))
    return last.where("m.op = 'add'").select("gid", "sid")
