"""Filling containers of a fixed capacity with items.

Items meet in random shards of bounded size. In each, best fit decreasing fills bins, then a local
search empties bins: it moves an item, exchanges one for one or two for one between underfull bins
whenever that raises the sum of squared fills, until the emptiest bins dissolve. Bins that are full
enough are done; the items of the others meet again in fewer, newly mixed shards, so what space is
left over is that of a few bins however many shards there were.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.durable import durable

SHARD_ITEMS = 2_500
FULL = 0.99  # a bin this full is done
LEAST_GAIN = 0.001  # rounds go on while each saves at least this share of the underfull containers


def fill_bins(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: lists of item numbers."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        bisect.insort(free, (room - sizes[i], b))
    return bins


def _lesser(x: int, room: int, own: list[tuple[int, int]]) -> tuple[int, ...] | None:
    """What a bin with ``room`` gives for item size ``x``: its least one or two items that make ``x`` fit and are less. ``own`` is sorted."""
    need = x - room
    at = bisect.bisect_left(own, (need, -1))
    best, items = (own[at][0], (own[at][1],)) if at < len(own) else (x, None)
    if best == need:
        return items
    low, high = 0, len(own) - 1
    while low < high:  # two pointers: linear in the bin's items, however many
        both = own[low][0] + own[high][0]
        if both < need:
            low += 1
        else:
            if both < best:
                best, items = both, (own[low][1], own[high][1])
            high -= 1
    return items if best < x else None


def empty_bins(bins: list[list[int]], sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Local search over the bins under ``full``: moves, exchanges of one for one and two for one.

    Each step goes from the emptiest bin on and raises the sum of squared fills, so it ends. Bins keep their items
    sorted; a step changes two of them, and only bins that changed since are looked at again.
    """
    kept = [b for b in bins if sum(sizes[i] for i in b) >= full * capacity]
    held = [sorted((sizes[i], i) for i in b) for b in bins if sum(sizes[i] for i in b) < full * capacity]
    fill = [sum(s for s, _ in b) for b in held]
    live = {b for b in range(len(held)) if held[b]}
    clock, touched, looked = 1, [1] * len(held), [0] * len(held)  # when a bin last changed, and when last none took its items
    changed = True
    while changed and len(live) > 1:
        changed = False
        for victim in sorted(live, key=lambda b: (fill[b], b)):
            for x in sorted(held[victim], reverse=True):
                best = None
                for b in live:
                    if b == victim or fill[b] < fill[victim] or fill[b] >= capacity or looked[victim] >= max(touched[b], touched[victim]):
                        continue
                    room = capacity - fill[b]
                    give = () if x[0] <= room else _lesser(x[0], room, held[b])
                    if give is not None:
                        gain = x[0] - sum(sizes[i] for i in give)
                        rise = gain * (fill[b] - fill[victim] + gain)
                        if best is None or (rise, -b) > best[:2]:
                            best = (rise, -b, give, gain)
                if best:
                    _, b, give, gain = best
                    b = -b
                    held[victim].remove(x)
                    for i in give:
                        held[b].remove((sizes[i], i))
                        bisect.insort(held[victim], (sizes[i], i))
                    bisect.insort(held[b], x)
                    fill[b] += gain
                    fill[victim] -= gain
                    clock += 1
                    touched[b] = touched[victim] = clock
                    changed = True
                    if not held[victim] or fill[b] >= full * capacity:
                        live -= {v for v in (victim, b) if not held[v] or fill[v] >= full * capacity}
                    if not held[victim]:
                        break
            if not changed:
                looked[victim] = clock
            if changed:
                break
    return kept + [[i for _, i in b] for b in held if b]


def pack_shard(sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    return empty_bins(fill_bins(sizes, capacity), sizes, capacity, full)


def pieces(sized: DataFrame, size: str, capacity: int) -> DataFrame:
    """Adds piece (from 0) and piece_size: an item within the capacity is one piece, a larger one is cut into full pieces and a rest.

    Items of size null, 0 or less need no container and have no row.
    """
    n = F.col(size).cast("bigint")
    cut = F.transform(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int")), lambda p: F.struct(p.cast("int").alias("piece"), F.least(F.lit(capacity), n - p * capacity).alias("piece_size")))
    return sized.where(n > 0).withColumn("_p", F.explode(cut)).select("*", "_p.piece", "_p.piece_size").drop("_p")


def _filler(step: int, capacity: int):
    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable").reset_index(drop=True)
        sizes = [int(s) for s in frame["piece_size"]]
        name, open_ = np.empty(len(sizes), object), np.zeros(len(sizes), bool)
        for k, b in enumerate(pack_shard(sizes, capacity)):
            under = sum(sizes[i] for i in b) < FULL * capacity
            for i in b:
                name[i], open_[i] = f"{step}-{frame['shard'].iat[0]}-{k}", under
        return frame.assign(container=name, under=open_)[["key", "size", "piece", "piece_size", "item", "container", "under"]]

    return fill


def pack(sized: DataFrame, key: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, size, piece, piece_size, container): every item's pieces with the container that holds each.

    Rows with equal keys are items of their own, and are spread over the shards as others are: what meets is drawn by
    a number that each piece gets when the pieces are written.
    """
    spark = sized.sparkSession
    kind = sized.schema[key].dataType.simpleString()
    cut = pieces(sized.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")), "size", capacity)
    cut = durable(cut.withColumn("item", F.monotonically_increasing_id()))
    columns = ["key", "size", "piece", "piece_size", "container"]
    done = [cut.where(F.col("piece_size") == capacity).withColumn("container", F.concat(F.lit("w-"), "item")).select(columns)]
    rest = cut.where(F.col("piece_size") < capacity)
    n, bins, step = rest.count(), None, 0
    while n:
        shards = -(-n // shard_items)
        parts = min(shards, 50 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        mixed = rest.select("key", "size", "piece", "piece_size", "item", F.pmod(F.xxhash64("item", F.lit(step)), F.lit(shards)).alias("shard"))
        # placed by number, else several shards would share a task and others stand idle
        filled = mixed.repartition(parts, "shard").groupBy("shard").applyInPandas(_filler(step, capacity), f"key {kind}, size long, piece int, piece_size long, item long, container string, under boolean")
        made = durable(filled)
        left, now = made.where("under").agg(F.count(F.lit(1)), F.countDistinct("container")).first()
        again = shards > 1 and left > 0 and (bins is None or bins - now >= LEAST_GAIN * bins)
        done.append((made.where("NOT under") if again else made).select(columns))
        rest, n, bins, step = made.where("under").drop("container", "under"), left if again else 0, now, step + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("key", key).withColumnRenamed("size", size)


def packing_report(packed: DataFrame, key: str, capacity: int) -> DataFrame:
    """One row: pieces, their total size, containers, the least number there could be, and how many containers hold more than the capacity."""
    bins = packed.groupBy("container").agg(F.sum("piece_size").alias("fill"), F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("fill"), F.lit(0)).cast("bigint")
    return bins.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pieces"), total.alias("total_size"), F.count(F.lit(1)).alias("containers"),
        F.ceil(total / capacity).cast("bigint").alias("least_containers"), F.count_if(F.col("fill") > capacity).alias("overfull"),
    )
