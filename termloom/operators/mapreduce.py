"""The generic map-reduce operator over (key, value) tables.

Mappers, combiners and reducers are Python callables. Records whose mapper fails and keys whose combiner or reducer
fails are put out with their error instead of vanishing, so a caller can count and inspect them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a map task holds for its combiner before it puts them out.
HELD_KEYS = 200_000
MAPPED = "key string, value string, error string"


def _frame(rows: list[tuple[str | None, str | None, str | None]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "value", "error"], dtype=object)


def _failed(key: str | None, e: Exception) -> tuple[str | None, None, str]:
    return key, None, f"{type(e).__name__}: {e}"


def map_pairs(rows: DataFrame, mapper: Callable[[str, str], Any], combiner: Callable[[str, list], Any] | None = None) -> DataFrame:
    """(key, value as JSON, error): every property of every object the mapper returns is one pair; None is none.

    A combiner makes one value of a key's values so far, within the map task: what is exchanged is then at most one pair
    for each task, key and HELD_KEYS keys, also for a key with a third of all pairs.
    """
    if not callable(mapper):
        raise TypeError("mapper must be callable")

    def pairs(frame: pd.DataFrame, out: list) -> Iterator[tuple[str, Any]]:
        for key, value in zip(frame["key"], frame["value"]):
            try:
                made = mapper(key, value)
                made = [] if made is None else made if isinstance(made, list) else [made]
                yield from [(str(k), v) for m in made if m for k, v in m.items()]
            except Exception as e:  # noqa: BLE001 - a record's failure is data
                out.append(_failed(key, e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str | None, str | None, str | None]] = []
            made = [(k, json.dumps(v), None) for k, v in pairs(frame, out)]
            yield _frame(made + out)

    def combine(held: dict[str, list]) -> pd.DataFrame:
        out = []
        for key, values in held.items():
            try:
                out.append((key, json.dumps(values[0] if len(values) == 1 else combiner(key, values)), None))
            except Exception as e:  # noqa: BLE001
                out.append(_failed(key, e))
        held.clear()
        return _frame(out)

    def run_combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for frame in frames:
            out: list[tuple[str | None, str | None, str | None]] = []
            for k, v in pairs(frame, out):
                values = held.setdefault(k, [])
                values.append(v)
                if len(values) == 1000:
                    try:
                        values[:] = [combiner(k, values)]
                    except Exception as e:  # noqa: BLE001
                        out.append(_failed(k, e))
                        values.clear()
            if out:
                yield _frame(out)
            if len(held) > HELD_KEYS:
                yield combine(held)
        yield combine(held)

    return rows.select("key", "value").mapInPandas(run if combiner is None else run_combined, MAPPED)


def reduce_pairs(pairs: DataFrame, reducer: Callable[[str, list], Any]) -> DataFrame:
    """(key, value as JSON, error) of the reducer's result for each key and its values in a fixed order.

    Sorted partitions are read as streams: a key's values are a list only while its reducer, which asks for one, runs.
    """
    if not callable(reducer):
        raise TypeError("reducer must be callable")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str | None, str | None, str | None]] = []
        each = (pair for frame in frames for pair in zip(frame["key"], frame["value"]))
        for key, own in groupby(each, key=lambda p: p[0]):
            try:
                made = reducer(key, [json.loads(v) for _, v in own])
                if made is not None:
                    out.append((key, json.dumps(made), None))
            except Exception as e:  # noqa: BLE001
                out.append(_failed(key, e))
            if len(out) >= 10_000:
                yield _frame(out)
                out = []
        yield _frame(out)

    return pairs.where("error IS NULL").repartition("key").sortWithinPartitions("key", "value").mapInPandas(run, MAPPED)


def map_reduce(rows: DataFrame, mapper: Callable, reducer: Callable, keys: DataFrame | None = None, combiner: Callable | None = None) -> DataFrame:
    """map, combine, exchange by key, reduce; ``keys`` (key) restricts the input, unknown ones are ignored."""
    chosen = rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")
    pairs = map_pairs(chosen, mapper, combiner)
    return reduce_pairs(pairs, reducer).unionByName(pairs.where("error IS NOT NULL"))
