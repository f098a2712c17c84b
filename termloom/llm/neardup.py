"""Groups of texts that repeat one another with small edits.

A text is the set of its word sequences ("tokens" below), two texts are alike if the Jaccard
similarity of their sets reaches a threshold t. Tokens are hashed into ``2**group_bits`` groups
and a text is the point of its group counts. The overlap of two texts is at most the sum of the
coordinate-wise minima of their points, and alike texts of sizes m and n overlap in at least
a = ceil(t / (1 + t) * (m + n)) tokens.

This is not an R-tree over those points: one was measured and given up, since the bounding boxes of
unrelated texts overlap in every dimension and it compares nearly all pairs (README). The points are
indexed by their leading coordinates instead, with the same bound:

* Coordinates are ordered from the group with the least mass in the collection to the one with the
  most. If the minima summed over the coordinates of two texts reach a, then among the first
  m - a + s tokens of the one and the first n - a + s of the other at least s are shared (s <= a).
  So a text enters the index only at its leading coordinates, and texts that share none are never
  looked at together.
* Entries are exchanged by token into slabs; in a slab they are sorted by (token, size). An entry's
  place p bounds what is left: two entries can still reach a only if p < m - a + s on either side,
  and sizes are within t. Entry pairs failing the bound are cut before they are made.

Pairs left with s shared leading tokens over all slabs are verified on their whole token sets.

Texts with equal words are one class, which enters the index once, so copies cost no pairs. Tokens
so common that their entries would make a long run are split into blocks by class and meet as block
pairs. Which tokens those are is estimated from the group masses: what a group holds beyond the
median group. An estimate only chooses the route; every pair that shares a token meets on any route.
No alike pair is lost, but for texts that 64 bits of hash take for copies.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.durable import durable
from termloom.llm.shingles import mix, plain_words, shingle_sets, word_count

WIDTH, THRESHOLD = 5, 0.8
MIN_GROUP_BITS, MAX_GROUP_BITS = 16, 23  # groups grow with the tokens; their masses are sent to every executor, 32 MB at most
TOKENS_A_GROUP = 12
SHARED = 8  # s: leading tokens that alike texts must share
LEAF = 4096  # entries of one token that are compared as one block
SLAB_TOKENS = 2_000_000  # tokens of the collection for each slab
MAX_PARTS = 20_000  # beyond so many slabs a partition holds several, sorted, and reads one after the other
_EXPANDED = 4_000_000  # entries of common tokens made at once
_BLOCK = 4096


def classes_of(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, cls, words) of each row with at least ``min_words`` words; equal words have equal cls.

    cls is a 64-bit hash of the words. A null key or text has no row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t.as_py()) for t in batch.column(1)], pa.string())], names=["key", "words"])

    kind = docs.schema[key].dataType.simpleString()
    words = docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("_text")).mapInArrow(read, f"key {kind}, words string")
    return words.where(word_count(F.col("words")) >= min_words).select("key", F.xxhash64("words").alias("cls"), "words")


def _least_overlap(t: float, total: np.ndarray) -> np.ndarray:
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def _blocks_sum(batches: Iterator[pa.RecordBatch], how, start, put) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = start(zlib.decompress(data))
            if block in held:
                how(held[block], x, out=held[block])
            else:
                held[block] = x.copy()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([put(v).tobytes() for v in held.values()], pa.binary())], names=["block", "data"])


def _gathered(made: DataFrame, how, start, put, dtype: str, length: int, parts: int) -> np.ndarray:
    """The blocks of ``made``, combined by ``how``: an array of bounded size, whatever the input's."""
    summed = made.repartition(parts, "block").mapInArrow(lambda b: _blocks_sum(b, how, start, put), "block int, data binary")
    whole = np.zeros(length, dtype)
    for block, data in summed.collect():
        piece = np.frombuffer(bytes(data), dtype)
        whole[block * _BLOCK : block * _BLOCK + len(piece)] = piece
    return whole


def _emit_blocks(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = whole.reshape(-1, _BLOCK)
    used = np.flatnonzero(rows.any(axis=1))
    for k in range(0, len(used), 64):
        part = used[k : k + 64]
        # counts that fit in two bytes go as such
        small = [rows.itemsize == 8 and rows[i].max() < 2**16 for i in part]
        data = [zlib.compress((rows[i].astype(np.uint16) if s else rows[i]).tobytes(), 1) for i, s in zip(part, small)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _distinct_texts(batch: pa.RecordBatch, seen: set[int]) -> tuple[list[int], list[str]]:
    cls, texts = [], []
    for c, w in zip(batch.column(0).to_pylist(), batch.column(1)):
        if c not in seen:
            seen.add(c)
            cls.append(c)
            texts.append(w.as_py())
    return cls, texts


def group_masses(classes: DataFrame, width: int, group_bits: int) -> np.ndarray:
    """How many tokens of the collection fall in each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(1 << group_bits, np.int64), set()
        for batch in batches:
            _, texts = _distinct_texts(batch, seen)
            for _, _, h in shingle_sets(texts, width):
                np.add.at(held, (h >> np.uint64(52 - group_bits)).astype(np.int64), 1)
        yield from _emit_blocks(held)

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = classes.select("cls", "words").mapInArrow(count, "block int, data binary")
    counts = lambda data: np.frombuffer(data, np.uint16 if len(data) == 2 * _BLOCK else np.int64).astype(np.int64)
    return _gathered(made, np.add, counts, lambda v: v.astype(np.float32), "float32", 1 << group_bits, parts)


_STEP = 1024  # places in the order for each doubling of the mass


def _places_of(masses: np.ndarray) -> np.ndarray:
    """16 bits by which the groups are ordered: the logarithm of their mass."""
    return np.floor(np.log2(1.0 + masses) * _STEP).astype(np.uint16)


def _blocks_of(place: np.ndarray, usual: float) -> np.ndarray:
    """Into how many blocks the entries of a token fall, 1 if they stay together: by what its group holds beyond the usual."""
    load = np.exp2(place.astype(np.float64) / _STEP) - 1.0 - usual
    return np.where(load >= LEAF, np.ceil(load / LEAF) + 1, 1).astype(np.int64)


def _steps(step: np.ndarray, place: np.ndarray) -> bytes:
    """Places as the steps between them, a byte each, or as they are where a step is too long or goes back."""
    return step.astype(np.uint8).tobytes() if ((step >= 0) & (step < 256)).all() else place.astype(np.uint16).tobytes()


def _from_steps(places: list[bytes], many: np.ndarray) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(x, np.uint8), dtype=np.int64) if len(x) == n else np.frombuffer(x, np.uint16).astype(np.int64) for x, n in zip(places, many)])


def _route(classes: DataFrame, masses: np.ndarray, width: int, t: float, slabs: int) -> DataFrame:
    """One row for each class and slab: its leading tokens there, their places, and its size."""
    spark = classes.sparkSession
    usual = float(np.median(masses[masses > 0])) if masses.any() else 0.0
    sent = spark.sparkContext.broadcast(_places_of(masses))
    bits = int(math.log2(len(masses)))

    def rows(cls: np.ndarray, size: np.ndarray, token: np.ndarray, place: np.ndarray, side: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        slab = (token >> np.uint64(33)).astype(np.int64) % slabs
        o = np.lexsort((slab, d))
        slab, d, token, place, side = slab[o], d[o], token[o], place[o], side[o]
        cut = np.flatnonzero(np.concatenate([[True], (slab[1:] != slab[:-1]) | (d[1:] != d[:-1])])) if len(d) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(slab)]]) if len(d) else cut
        tok = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        plc = np.minimum(place, 65535).astype(np.int64)  # a smaller place only lets more pairs through
        step = np.diff(plc, prepend=0)
        step[cut] = plc[cut]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(slab[cut], pa.int32()),
                pa.array(cls[d[cut]], pa.int64()),
                pa.array(size[d[cut]], pa.int32()),
                pa.array([tok[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                pa.array([_steps(step[a:b], plc[a:b]) for a, b in zip(cut, ends)], pa.binary()),
                pa.array([side[a:b].tobytes() if (side[a:b] != 2).any() else None for a, b in zip(cut, ends)], pa.binary()),
            ],
            names=["slab", "cls", "n", "tokens", "places", "sides"],
        )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, set()
        for batch in batches:
            cls, texts = _distinct_texts(batch, seen)
            for first, doc, h in shingle_sets(texts, width):
                if not len(h):
                    continue
                at = order[(h >> np.uint64(52 - bits)).astype(np.int64)].astype(np.uint64)
                key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (at << np.uint64(36)) | (h & np.uint64((1 << 36) - 1)))
                size = np.bincount(doc)
                place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                n = size[doc]
                least = np.ceil(t * n - 1e-9).astype(np.int64)  # overlap with the smallest partner there can be
                lead = place < n - least + np.minimum(SHARED, least)
                key, place, d = key[lead], place[lead], doc[lead]
                token = mix(key & np.uint64((1 << 52) - 1))
                blocks = _blocks_of((key >> np.uint64(36)) & np.uint64(65535), usual)
                ids = np.array(cls[first : first + len(size)], np.int64)
                # texts with many entries in common tokens go in smaller lots
                load = np.cumsum(np.bincount(d, weights=np.where(blocks > 1, blocks, 0), minlength=len(size)))
                lot = (load // _EXPANDED).astype(np.int64)[d]
                for k in np.unique(lot):
                    own = lot == k
                    yield rows(ids, size, *_spread(token[own], place[own], blocks[own], d[own], ids.view(np.uint64)))

    return classes.select("cls", "words").mapInArrow(route, "slab int, cls long, n int, tokens binary, places binary, sides binary")


def _spread(token: np.ndarray, place: np.ndarray, blocks: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, place, side, d) with the common tokens' entries replaced by those of their block pairs."""
    side = np.full(len(token), 2, np.uint8)
    many = blocks > 1
    if not many.any():
        return token, place, side, d
    at, tok, sides = _split(token[many], blocks[many], ids[d[many]])
    src = np.flatnonzero(many)[at]
    keep = ~many
    return np.concatenate([token[keep], tok]), np.concatenate([place[keep], place[src]]), np.concatenate([side[keep], sides]), np.concatenate([d[keep], d[src]])


def _split(token: np.ndarray, k: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A common token's entries fall into k blocks by class; each enters its k block pairs under a token made for the pair."""
    mine = (mix(cls) % k.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(token)), k)
    other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
    lo, hi = np.minimum(mine[at], other), np.maximum(mine[at], other)
    tok = mix(token[at] + np.uint64(0x9E3779B97F4A7C15) * ((lo << 31) + hi + 1).astype(np.uint64))
    side = np.where(lo == hi, 2, np.where(mine[at] == lo, 0, 1)).astype(np.uint8)
    return at, tok, side


def _pairs_in_slab(cls: np.ndarray, n: np.ndarray, token: np.ndarray, place: np.ndarray, side: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class, class, tokens they must share) of the pairs of entries that pass the bound."""
    o = np.lexsort((n, token))
    token, cls, n, place, side = token[o], cls[o], n[o].astype(np.int64), place[o].astype(np.int64), side[o]
    # partners stand behind an entry in its token's run, up to the size that is still within t
    run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    wide = int(n.max()) + 1 if len(n) else 1
    end = np.searchsorted(run * wide + n, run * wide + np.minimum(np.floor((n + 1e-9) / t).astype(np.int64), wide - 1), side="right")
    least = _least_overlap(t, 2 * n)
    smaller = np.flatnonzero(place < n - least + np.minimum(SHARED, least))
    rest = end[smaller] - smaller - 1
    smaller, rest = smaller[rest > 0], rest[rest > 0]
    step = np.concatenate([[0], np.cumsum(rest)])
    begin = 0
    while begin < len(smaller):
        stop = max(begin + 1, int(np.searchsorted(step, step[begin] + 2_000_000)) - 1)
        r = rest[begin:stop]
        i = np.repeat(smaller[begin:stop], r)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(r) - r, r)
        a = _least_overlap(t, n[i] + n[j])
        s = np.minimum(SHARED, a)
        ok = (n[j] * t <= n[i] + 1e-9) & (place[i] < n[i] - a + s) & (place[j] < n[j] - a + s) & ((side[i] == 2) | (side[i] != side[j])) & (cls[i] != cls[j])
        i, j = i[ok], j[ok]
        yield np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), s[ok]
        begin = stop


def _candidates(routed: DataFrame, t: float, slabs: int) -> DataFrame:
    """Class pairs (a, b, least) that share at least ``s`` leading tokens over all slabs."""

    def of_slab(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        # a class may come from several tasks, each with the same row: it counts once
        _, once = np.unique(table.column("cls").to_numpy(), return_index=True)
        table = table.take(pa.array(np.sort(once))) if len(once) < len(table) else table
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        tokens = table.column("tokens").to_pylist()
        token, many = np.frombuffer(b"".join(tokens), np.uint32), np.array([len(x) // 4 for x in tokens])
        place = _from_steps(table.column("places").to_pylist(), many)
        side = np.frombuffer(b"".join(x if x is not None else b"\x02" * k for x, k in zip(table.column("sides").to_pylist(), many)), np.uint8)
        row = np.repeat(np.arange(len(cls)), many)
        # tokens that agree in 32 bits count as one: pairs may look more alike than they are, never less
        for a, b, need in _pairs_in_slab(cls[row], n[row], token, place, side, t):
            if not len(a):
                continue
            o = np.lexsort((b, a))
            a, b, need = a[o], b[o], need[o]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            # one number for what must be shared and what is
            both = (need[new] << 24) + np.minimum(np.diff(np.concatenate([new, [len(a)]])), (1 << 24) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(both, pa.int32())], names=["a", "b", "both"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            slab = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(slab[1:] != slab[:-1]) + 1).tolist(), len(slab)] if len(slab) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != slab[a]:
                    yield from of_slab(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from of_slab(held)

    parts = min(slabs, max(MAX_PARTS, int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = routed.repartitionById(parts, F.pmod("slab", F.lit(parts)))
    met = (placed if parts == slabs else placed.sortWithinPartitions("slab")).mapInArrow(meet, "a long, b long, both int")
    shared, need = F.sum(F.col("both").bitwiseAND(F.lit((1 << 24) - 1))), F.max(F.shiftright("both", 24))
    return met.groupBy("a", "b").agg(shared.alias("shared"), need.alias("need")).where("shared >= need").select("a", "b")


def _bitmap_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 64-bit ids: ``2**bits`` bits at any number of ids; more ids only pass more rows."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            held[(mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
        packed = np.packbits(held)
        yield from _emit_blocks(packed)

    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    as_bytes = lambda data: np.frombuffer(data, np.uint8)
    return _gathered(ids.mapInArrow(mark, "block int, data binary"), np.bitwise_or, as_bytes, lambda v: v, "uint8", 1 << (bits - 3), parts)


def _texts_of(classes: DataFrame, ids: DataFrame, bits: int = 22) -> DataFrame:
    """(cls, words) once for each class among ``ids``, and some others."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(_bitmap_of(ids, bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids_ = batch.column(0).to_numpy()
            at = (mix(ids_.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            inside = np.flatnonzero((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            new = []
            for i, c in zip(inside, ids_[inside].tolist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return classes.select("cls", "words").mapInArrow(pick, "cls long, words string").dropDuplicates(["cls"])


def alike_classes(classes: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, similarity) of different classes, a < b, with similarity >= ``threshold``. No alike pair is lost."""
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.greatest(word_count(F.col("words")) - (width - 1), F.lit(0)).cast("bigint"))).first()[0] or 0
    group_bits = min(MAX_GROUP_BITS, max(MIN_GROUP_BITS, math.ceil(math.log2(total / TOKENS_A_GROUP + 1))))
    masses = group_masses(classes, width, group_bits)
    slabs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SLAB_TOKENS))
    near = durable(_candidates(_route(classes, masses, width, threshold, slabs), threshold, slabs))
    texts = _texts_of(classes, near.select(F.explode(F.array("a", "b")).alias("cls")))
    both = near.join(texts.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                m = batch.num_rows
                # text 2i and 2i + 1 are the sides of pair i
                texts_ = [w for ab in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist()) for w in ab]
                pair, h = [], []
                size = np.zeros(2 * m, np.int64)
                for first, doc, x in shingle_sets(texts_, width):
                    size += np.bincount(doc + first, minlength=2 * m)
                    pair.append((doc + first) >> 1)
                    h.append(x)
                p, x = np.concatenate(pair), np.concatenate(h)
                o = np.lexsort((x, p))
                p, x = p[o], x[o]
                twice = (p[1:] == p[:-1]) & (x[1:] == x[:-1])
                shared = np.bincount(p[1:][twice], minlength=m)
                union = size[0::2] + size[1::2] - shared
                j = shared / np.maximum(union, 1)
                ok = np.flatnonzero((j >= threshold) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(j[ok])], names=["a", "b", "similarity"])

    return both.select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long, similarity double")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable over ``edges``.

    Alternates the large-star and small-star steps until nothing changes, a number of rounds that
    grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        # large star: each node's larger neighbours move to its least neighbour
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = durable(small)
        same = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = then
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def alike_pairs(docs: DataFrame, key: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD, min_words: int = 1) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of keys whose texts are alike, copies included.

    Keys with the same words are pairs too (if they have a token at all). Repeated rows of a key count once.
    """
    classes = durable(classes_of(docs, key, text, max(min_words, width)))
    links = alike_classes(classes, width, threshold).select("a", "b")
    members = classes.select("cls", "key").distinct()
    left, right = members.select(F.col("cls").alias("a"), F.col("key").alias("x")), members.select(F.col("cls").alias("b"), F.col("key").alias("y"))
    across = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
    return across.unionByName(copies).distinct()


def alike_groups(docs: DataFrame, key: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each key: ``class_id``, the least key with its words, ``group_id``, the least key of the texts alike
    over any number of steps, ``n_links`` to different texts and ``n_copies`` of keys with its words (itself included).

    Texts under ``width`` words have no token and are alike only to copies; texts without words, null
    ones too, are copies of one another. A null key has no row.
    """
    rows = durable(classes_of(docs, key, text, 0))
    links = durable(alike_classes(rows.where(word_count(F.col("words")) >= width), width, threshold).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    members = rows.select("key", "cls").distinct()
    named = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_copies"), F.min("key").alias("class_id"))
    group = components(links).withColumnRenamed("node", "cls").join(named.select("cls", "class_id"), "cls")
    group_id = group.groupBy("component").agg(F.min("class_id").alias("group_id"))
    info = named.join(degree, "cls", "left").join(group.select("cls", "component").join(group_id, "component"), "cls", "left")
    return members.join(info, "cls").select(
        F.col("key").alias(key), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
