"""Exact ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from termloom.durable import durable

ROWS_A_PART = 500_000
_MORE = [StructField("n_less", LongType()), StructField("n_equal", LongType()), StructField("n_total", LongType()), StructField("part", IntegerType()), StructField("open", BooleanType()), StructField("edge", BooleanType())]


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; null equals null and NaN equals NaN."""
    after, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(after, before), pc.xor(pc.is_null(after), pc.is_null(before)))
    if pa.types.is_floating(column.type):
        differs = pc.and_not(differs, pc.and_(pc.fill_null(pc.is_nan(after), False), pc.fill_null(pc.is_nan(before), False)))
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False).astype(bool)])


def _local(table: pa.Table, group: list[str], value: list[str], part: int) -> list[pa.Array]:
    """Ranks within one sorted part. Its first and last group may go on in other parts (open), and so may their least and greatest values (edge)."""
    n = len(table)
    new_group = np.logical_or.reduce([_changes(table.column(c)) for c in group])
    new_value = np.logical_or.reduce([new_group, *[_changes(table.column(c)) for c in value]])
    at = np.arange(n)
    g_start, g_id = np.flatnonzero(new_group), np.cumsum(new_group) - 1
    v_start, v_id = np.flatnonzero(new_value), np.cumsum(new_value) - 1
    g_end, v_end = np.append(g_start[1:], n), np.append(v_start[1:], n)
    open_ = (g_id == 0) | (g_id == g_id[-1])
    edge = open_ & ((v_start[v_id] == g_start[g_id]) | (v_end[v_id] == g_end[g_id]))
    less, equal, total = v_start[v_id] - g_start[g_id], (v_end - v_start)[v_id], (g_end - g_start)[g_id]
    return [pa.array(x) for x in (less.astype(np.int64), equal.astype(np.int64), total.astype(np.int64), np.full(len(at), part, np.int32), open_, edge)]


def row_ranks(rows: DataFrame, group: list[str], value: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with n_less, n_equal and n_total: of each row's group the rows with a lesser value, with the same one, and all.

    Rows are range-partitioned by group, value and all their columns, so neither a group nor a value that holds a
    third of the rows gathers in one task; each sorted part ranks its rows by itself. Only a part's first and last
    group can go on elsewhere: their counts, at most four rows a part, are added up and sent to every task.
    Null is less than any value and NaN the greatest. ``rows`` is read twice. Rows move once.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*group, *value]
    salt = F.xxhash64(*[F.col(c) for c in rows.columns])
    placed = rows.repartitionByRange(parts, *names, salt).sortWithinPartitions(*names).withColumn("part", F.spark_partition_id())
    out = StructType([*rows.schema.fields, *_MORE])
    arrow = to_arrow_schema(rows.schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            part = table.column("part")[0].as_py()
            table = table.drop_columns(["part"]).cast(arrow)
            for k, column in enumerate(_local(table, group, value, part)):
                table = table.append_column(_MORE[k].name, column)
            yield from table.to_batches(max_chunksize=100_000)

    ranked = durable(placed.mapInArrow(rank, out))
    by_part = ranked.where("open").groupBy(*group, "part").agg(F.max("n_total").alias("n"))
    before, whole = Window.partitionBy(*group).orderBy("part"), Window.partitionBy(*group)
    offsets = by_part.select(*group, "part", (F.sum("n").over(before) - F.col("n")).alias("_offset"), F.sum("n").over(whole).alias("_all"))
    at_edge = ranked.where("edge").groupBy(*names, "part").agg(F.max("n_less").alias("n_less"), F.max("n_equal").alias("n_equal"))
    runs = null_safe_join(at_edge, offsets, [*group, "part"]).groupBy(*names).agg(F.min(F.col("_offset") + F.col("n_less")).alias("_less"), F.sum("n_equal").alias("_equal"))
    # both have at most four rows for each part
    spread = null_safe_join(ranked, F.broadcast(offsets), [*group, "part"], "left", F.col("x.open"))
    spread = null_safe_join(spread, F.broadcast(runs), names, "left", F.col("x.edge"))
    less = F.coalesce("_less", F.col("n_less") + F.col("_offset"), "n_less")
    return spread.select(*rows.columns, less.alias("n_less"), F.coalesce("_equal", "n_equal").alias("n_equal"), F.coalesce("_all", "n_total").alias("n_total"))


def null_safe_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", only: Column | None = None) -> DataFrame:
    """Join on columns in which null equals null; the left side's columns stay."""
    on = only
    for c in columns:
        same = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        on = same if on is None else on & same
    more = [f"y.{c}" for c in right.columns if c not in columns]
    return left.alias("x").join(right.alias("y"), on, how).select("x.*", *more)
