"""The training-text operators against brute force, on small inputs with every kind of dirt."""

import collections
import itertools
import math
import os
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import markup, mixing, neardup, packing, postings, quality, queries, rankfuse, repeated_lines, shingles, tokens
from termloom.llm.ranks import row_ranks

DATA = "/root/testdata/sf0.001"


# shingles


def test_shingle_sets_match_plain_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "d"]) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["x", "a b", "a b c"]
    ids: dict[int, tuple] = {}
    seen = 0
    for first, doc, h in shingles.shingle_sets(texts, 3):
        for k in range(doc.max() + 1 if len(doc) else 0):
            w = texts[first + k].split()
            want = set(zip(w, w[1:], w[2:]))
            got = h[doc == k].tolist()
            assert len(got) == len(want) == len(set(got))
            seen += len(got)
    assert seen == sum(len(set(zip(w, w[1:], w[2:]))) for w in (t.split() for t in texts)) and not ids


def test_words_of(spark):
    rows = spark.createDataFrame([("Ab-c 1d\r\nE",), (None,), ("",), ("é",)], "t string").select(shingles.words_of(F.col("t")).alias("w")).withColumn("n", shingles.word_count(F.col("w"))).collect()
    assert [(r.w, r.n) for r in rows] == [("ab c d e", 4), ("", 0), ("", 0), ("", 0)]


def test_plain_words_are_those_of_the_expression(spark):
    texts = ["Ab-c 1d\r\nE", None, "", "é", "Ünï\tcode İstanbul \u212Aelvin ﬁx ß Ǆ x", "\x00a\x7fb", "a" * 70_000 + " B", "中文 words 混合"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shingles.words_of(F.col("t")).alias("w")).collect()
    assert [shingles.plain_words(r.t) for r in rows] == [r.w for r in rows]


# near-duplicates


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    return words


def near_corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 3, 8, 20]))) for _ in range(rng.randint(1, 5))]
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts)] + [("copy", texts[0]), ("copy", texts[0]), ("null", None), ("empty", ""), ("short", "a b c d e f"), (None, texts[0])]
    return rows + [("long", " ".join(rng.choice(vocabulary) for _ in range(60_000)))]


def brute_pairs(rows, width, t, least):
    sets = {}
    for k, x in rows:
        w = re.findall("[a-z]+", (x or "").lower())
        if k and len(w) >= max(least, width):
            sets[k] = set(zip(*(w[i:] for i in range(width))))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (i := len(sets[a] & sets[b])) and i / (len(sets[a]) + len(sets[b]) - i) >= t}


@pytest.mark.parametrize(("width", "t", "leaf", "bits"), [(3, 0.5, 4096, 23), (5, 0.8, 4096, 23), (3, 0.3, 3, 23), (3, 0.5, 20, 12)])
def test_near_duplicates(spark, monkeypatch, width, t, leaf, bits):
    rows = near_corpus()
    df = spark.createDataFrame([(k, x, "c", 1) for k, x in rows], "id string, body string, cls string, key int")
    classes = neardup.classes_of(df, "id", "body", width)
    monkeypatch.setattr(neardup, "LEAF", leaf)  # a small leaf makes every common token meet in block pairs
    monkeypatch.setattr(neardup, "MIN_GROUP_BITS", min(bits, 16))
    monkeypatch.setattr(neardup, "MAX_GROUP_BITS", bits)  # few groups: each holds many tokens, all masses are alike
    monkeypatch.setattr(neardup, "_EXPANDED", 4_000_000 if leaf > 3 else 50)
    if leaf < 4096:
        monkeypatch.setattr(neardup, "MAX_PARTS", 3)  # several slabs in a partition
        monkeypatch.setattr(neardup, "SLAB_TOKENS", 2_000)
    got = {tuple(r) for r in neardup.alike_pairs(df, "id", "body", width, t, 20).collect()}
    assert got == brute_pairs(rows, width, t, 20) and len(got) > 10
    assert classes.count() == len([1 for k, x in rows if k and len(re.findall("[a-z]+", x or "")) >= width])


def test_places_and_blocks_at_any_mass():
    masses = np.array([0, 1, 2, 65_535, 70_000, 3e9, 5e12], np.float32)
    places = neardup._places_of(masses)
    assert (np.diff(places.astype(int)) > 0).all()
    blocks = neardup._blocks_of(places, 100.0)
    assert blocks[:3].tolist() == [1, 1, 1] and blocks[4] == -(-(70_000 - 100) // neardup.LEAF) + 1 and blocks[5] == pytest.approx(3e9 / neardup.LEAF, rel=0.01)
    big = next(iter(neardup._emit_blocks(np.full(4096, 2**33, np.int64))))
    assert len(zlib.decompress(big.column(1)[0].as_py())) == 8 * 4096
    place = np.array([3, 9, 300, 301, 700])
    for p in (place, place[:2], place[::-1]):
        assert neardup._from_steps([neardup._steps(np.diff(p, prepend=0), p)], np.array([len(p)])).tolist() == p.tolist()


def test_near_duplicate_groups(spark):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "id string, body string")
    got = {r.id: r for r in neardup.alike_groups(df, "id", "body", 3, 0.5).collect()}
    keys = {k for k, _ in rows if k}
    assert set(got) == keys
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows, 3, 0.5, 3):
        parent[find(a)] = find(b)
    by = collections.defaultdict(set)
    for k in keys:
        by[find(k)].add(got[k].group_id)
    assert all(len(v) == 1 for v in by.values()) and len({g for v in by.values() for g in v}) == len({find(k) for k in keys - {"null", "empty"}}) + 1
    assert got["copy"].n_copies == 2 and got["null"].group_id == got["empty"].group_id and got["short"].n_links == 0
    assert neardup.alike_pairs(df.limit(0), "id", "body", 3, 0.5).count() == 0 and neardup.alike_groups(df.limit(0), "id", "body").count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in neardup.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# repeated lines


def test_repeated_lines(spark):
    note, other = "All rights belong to the Example Guild forever", "Another line that every page of many owners holds"
    rows = [(f"p{i}", f"Own sentence number {chr(97 + i)} about things and stuff\r\n{note.upper()} {i}\n\nshort\n{other}\n", " Guild ") for i in range(8)]
    rows += [(f"q{i}", f"{other}\nUnlike text {chr(97 + i)} for the others here\n" + ("\n" + note if i == 0 else ""), f"o{i % 5}") for i in range(40)]
    rows += [("p0", rows[0][1], "guild"), ("n", None, "guild"), ("b", note, "  "), ("z", note, None), (None, note, "guild")]
    df = spark.createDataFrame([(k, t, o, "x", 1) for k, t, o in rows], "id string, body string, own string, source string, key int")
    found = {(r.key, r.line_no) for r in repeated_lines.repeated_positions(df, "id", "own", "body").collect()}
    assert found == {(f"p{i}", 2) for i in range(8)}
    clean = {r.id: (r.body, r.n_removed) for r in repeated_lines.without_repeated_lines(df, "id", "own", "body").collect()}
    assert clean["p0"] == (f"Own sentence number a about things and stuff\r\n\nshort\n{other}\n", 1) and clean["n"] == (None, 0) and clean["b"] == (note, 0) and len(clean) == 51
    assert repeated_lines.repeated_positions(df.limit(0), "id", "own", "body").count() == 0


def test_every_line_is_a_hypothesis(spark):
    rows = [(f"p{i}", f"o{i % 7}", "\n".join(f"line of letters {'abcdefghij'[k]}" + "xyzw"[i % 4] * (i % (k + 2)) for k in range(6))) for i in range(60)]
    pages = {k: (o, {x for x in t.split("\n")}) for k, o, t in rows}
    inside, n_in = collections.Counter((o, x) for o, ls in pages.values() for x in ls), collections.Counter(o for o, _ in pages.values())
    overall = collections.Counter(x for _, ls in pages.values() for x in ls)
    got = repeated_lines.line_tests(repeated_lines.keyed_lines(spark.createDataFrame(rows, "id string, own string, body string"), "id", "own", "body", 5)).collect()
    assert sum(r.weight for r in got) == len(inside)
    part = lambda k, e: k * math.log(k / e) if k else 0
    want = collections.Counter()
    for (o, x), a in inside.items():
        b, m, n = overall[x] - a, n_in[o], 60
        k = a + b
        g2 = 2 * (part(a, m * k / n) + part(m - a, m * (n - k) / n) + part(b, (n - m) * k / n) + part(n - m - b, (n - m) * (n - k) / n))
        want[a, m, b, n - m, round(math.erfc(math.sqrt(max(0, g2) / 2)) if a * (n - m) > b * m else 1, 5)] += 1
    have = collections.Counter()
    for r in got:
        have[r.k_in, r.n_in, r.k_out, r.n_out, round(r.p, 5)] += r.weight
    assert have == want


@pytest.mark.parametrize("owners", [1, 3])
def test_lines_of_every_owner_are_found(spark, tmp_path, owners):
    from termloom.llm import queries

    rows = [(f"p{i}", f"o{i % owners}", f"All rights belong to the Example Guild\nUnlike text {'xyz'[i % 3] * (i + 1)} for the others") for i in range(15)]
    spark.createDataFrame(rows, "doc_key string, repoOwner string, text string").write.parquet(f"{tmp_path}/docs.parquet")
    assert {(r.doc_key, r.line_no) for r in queries.p1_found(spark, str(tmp_path)).collect()} == {(r[0], 1) for r in rows}
    assert {(r.doc_key, r.n_removed) for r in queries.p1_clean(spark, str(tmp_path)).collect()} == {(r[0], 1) for r in rows}


def test_significance_is_tested_where_it_decides(spark, tmp_path, monkeypatch):
    import duckdb

    note, shared, weak = "All rights belong to the Example Guild", "Every page of every owner holds this line", "Somewhat more often on the pages of one"
    rows = [(f"p{i}", f"o{i % 3}", "\n".join([f"Unlike text {'xyz'[i % 3] * (i + 1)} for the others", shared, *[note] * (i % 3 == 0), *[weak] * (i % 3 == 1 and i < 15 or i in (2, 5, 8, 11))])) for i in range(30)]
    spark.createDataFrame(rows, "doc_key string, repoOwner string, text string").write.parquet(f"{tmp_path}/docs.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW docs AS SELECT * FROM '{tmp_path}/docs.parquet/*.parquet'")
    run = lambda name: sorted((r.doc_key, r.line_no) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    at = lambda *lines: sorted((k, i) for k, _, t in rows for i, x in enumerate(t.split("\n"), 1) if x in lines)
    assert run("p1_excess") == at(note) == sorted(con.execute(queries.ORACLES["p1_excess"]).fetchall())
    assert run("p1_found") == at(note, shared, weak) == sorted(con.execute(queries.ORACLES["p1_found"]).fetchall())
    monkeypatch.setattr(repeated_lines, "line_tests", None)  # no work for a test that decides nothing
    assert run("p1_found") == at(note, shared, weak) and queries.p1_clean(spark, str(tmp_path)).where("n_removed > 0").count() == 30


def test_step_up_equals_the_rule(spark):
    rng = random.Random(6)
    for rate in (0.01, 0.3):
        ps = [rng.random() ** rng.choice([1, 3, 12]) for _ in range(400)] + [0.0, 0.0, 1.0, 1.0]
        s = sorted(ps)
        want = max((p for i, p in enumerate(s, 1) if p <= rate * i / len(s)), default=-1)
        bound = repeated_lines.step_up_bound(spark.createDataFrame([(p, 1) for p in ps], "p double, weight long"), rate)
        assert [p for p in s if p <= bound] == [p for p in s if p <= want]
    assert repeated_lines.step_up_bound(spark.createDataFrame([(0.5, 20)], "p double, weight long"), 0.01) == -1 == repeated_lines.step_up_bound(spark.createDataFrame([], "p double, weight long"), 0.01)


def test_tail_and_step_up(spark):
    xs = [0.0, 0.5, 3.841459, 6.634897, 30.0, 200.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(repeated_lines._tail(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in xs], rel=1e-5)
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    bound = repeated_lines.step_up_bound(spark.createDataFrame([(p, 1) for p in ps], "p double, weight long"), 0.05)
    assert [p for p in ps if p <= bound] == [0.001, 0.008]


# postings


STATE = "term string, url string, tf bigint, indexedAt timestamp_ntz, salt int, o int"


def log(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("a", "u", 5, at[1]), ("a", "u", 9, at[0]), ("a", "u", 5, at[1]), ("a", "v", None, at[2]), ("a", "v", 7, None), ("b", "u", 2, at[0]), ("b", "u", 4, at[0]), ("", "u", 3, at[0]), (None, "u", 3, at[0]), ("c", None, 1, at[0]), ("d", "w", 6, at[0]), ("d", "x", 1, at[0])]
    rows += [(f"t{i % 40}", "hot", i % 3 + 1, at[i // 40 % 3]) for i in range(240)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], STATE), rows


@pytest.mark.parametrize("far", [0, 2**62])
def test_latest_tf_of_any_size(spark, far):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    rows = [("a", "u", 5000, at[0]), ("a", "u", 2047, at[0]), ("a", "u", 9000, at[0]), ("b", "u", 1, None), ("b", "u", -3, at[0]), ("c", "u", 7, None), ("c", "u", 9, None), ("d", "u", far, at[1]), ("d", "u", 1, at[1])]
    got = {(r.term, r.url): r.tf for r in postings.latest_tf(spark.createDataFrame([(*r, 1, 2) for r in rows], STATE)).collect()}
    assert got == {("a", "u"): 9000, ("b", "u"): -3, ("c", "u"): 9, ("d", "u"): max(far, 1)}


def brute_state(rows):
    best: dict = {}
    for t, u, tf, at in rows:
        if t and u:
            best[t, u] = max(best.get((t, u), (0, -1)), (at.timestamp() if at else 0, 1 if tf is None else tf))
    return {k: v[1] for k, v in best.items()}


def test_latest_tf_and_marks(spark):
    df, rows = log(spark)
    want = brute_state(rows)
    state = postings.latest_tf(df)
    assert {(r.term, r.url): r.tf for r in state.collect()} == want
    urls = {u for _, u in want}
    marks = {r.term: (r.total, r.records, r.mark) for r in postings.term_marks(state, 1, 0.4).collect()}
    for t in {t for t, _ in want}:
        own = [v for (x, _), v in want.items() if x == t]
        assert marks.pop(t) == (sum(own), len(own), "rare" if len(own) <= 1 else "common" if len(own) >= 0.4 * len(urls) else "useful")
    assert not marks and postings.term_marks(postings.latest_tf(df.limit(0)), 1, 0.5).count() == 0


def test_association(spark):
    df, rows = log(spark)
    want = brute_state(rows)
    n_t, n_u = collections.Counter(), collections.Counter()
    for (t, u), v in want.items():
        n_t[t] += v
        n_u[u] += v
    smooth = sum(v**0.75 for v in n_u.values())
    got = {(r.term, r.url): r.ppmi for r in postings.association(postings.latest_tf(df)).collect()}
    assert got == pytest.approx({(t, u): max(0.0, math.log(v * smooth / (n_t[t] * n_u[u] ** 0.75))) for (t, u), v in want.items()})
    assert postings.association(postings.latest_tf(df.limit(0))).count() == 0


def found_and_sql(spark, path, rows):
    import duckdb

    spark.createDataFrame([(*r, None) for r in rows], "term string, url string, tf bigint, indexedAt timestamp_ntz").write.parquet(f"{path}/postings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW postings AS SELECT * FROM '{path}/postings.parquet/*.parquet'")
    return [tuple(r) for r in queries.p6_found(spark, str(path)).collect()], con.execute(queries.ORACLES["p6_found"]).fetchall()


def test_found_terms_stand_by_their_score(spark, tmp_path):
    rng = random.Random(9)
    tf = {(f"t{t}", f"u{u}"): rng.randint(1, 30) for t in range(40) for u in rng.sample(range(12), 1 + t % 11)}
    got, want = found_and_sql(spark, tmp_path, [(*k, v) for k, v in tf.items()])
    assert sorted(got) == sorted(want) and len(got) > 50
    n_t, n_u = collections.Counter(), collections.Counter()
    for (t, u), v in tf.items():
        n_t[t] += v
        n_u[u] += v
    smooth = sum(v**0.75 for v in n_u.values())
    scores = [max(0.0, math.log(tf[t, u] * smooth / (n_t[t] * n_u[u] ** 0.75))) for u, t in got]
    assert all(a > b - 1e-9 for a, b in itertools.pairwise(scores)) and scores[0] > scores[-1]


@pytest.mark.parametrize("rows", [[("a", "u", 2**62), ("a", "v", 2**62)], [("a", "u", 5), ("a", "v", -5), ("b", "v", 9), ("b", "w", 1)], [("a", "u", 5), ("b", "u", -5), ("a", "v", 1)]], ids=["sum", "term", "url"])
def test_no_tf_stops_the_found_terms(spark, tmp_path, rows):
    got, want = found_and_sql(spark, tmp_path, rows)
    assert sorted(got) == sorted(want) and got


def test_heavy_light_counts(spark):
    rows = [("hot", i % 5) for i in range(5000)] + [(f"v{i}", 1) for i in range(1500)] + [(None, 3), ("hot", None)]
    got = {r.value: (r.total, r.records) for r in postings.value_counts(spark.createDataFrame(rows, "at string, total int"), "at", "total").collect()}
    assert got["hot"] == (10000, 5001) and got["v3"] == (1, 1) and len(got) == 1501


def test_text_terms(spark):
    df = spark.createDataFrame([("a", "X y x"), ("a", "X y x"), ("b", None), (None, "x"), ("c", "")], "doc string, term string")
    got = {(r.url, r.term): r.tf for r in postings.text_terms(df, "doc", shingles.words_of(F.col("term"))).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1}


# ranks and fusion


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_row_ranks(spark, parts):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.0, 2.0, 2.0, float(rng.randrange(50)), float("nan")])) for g in ["a"] * 300 + ["b"] * 20 + [None] * 5 + [f"g{k}" for k in range(40)]]
    got = row_ranks(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, v double, i int"), ["g"], ["v"], parts).collect()
    assert sorted(r.i for r in got) == list(range(len(rows)))
    place = lambda v: (-1, 0) if v is None else (1, 0) if v != v else (0, v)
    for r in got:
        own = [place(x) for h, x in rows if h == r.g]
        assert (r.n_less, r.n_equal, r.n_total) == (sum(x < place(r.v) for x in own), own.count(place(r.v)), len(own))
    assert row_ranks(spark.createDataFrame([], "g string, v double"), ["g"], ["v"]).count() == 0


def test_inverse_normal(spark):
    ps = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.7, 0.99, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(rankfuse.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-6)


def test_fused_ranking(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = [(1, "a", 100.0, 0.1, t[0]), (1, "a", 1.0, 0.9, t[1]), (1, "b", 50.0, 0.1, t[0]), (1, "c", None, 0.5, t[0]), (1, "b", 50.0, 0.1, t[0]), (1, "d", 50.0, None, None), (2, "z", None, None, t[0]), (None, "a", 1.0, 1.0, t[0]), (1, None, 1.0, 1.0, t[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "q bigint, item string, g double, k double, at timestamp_ntz, down int")
    got = {(r.q, r.item): r for r in rankfuse.fused_ranking(df, "q", "item", ["g", "k"], "at", [2.0, 1.0]).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "z")}
    ndist = statistics.NormalDist()
    p1, p2 = {"a": 1.5, "b": 3.5, "c": 0.5 + 0.5, "d": 3.5}, {"a": 4.0, "b": 2.0, "c": 3.0, "d": 1.0}
    p1 = {"c": 1.0, "a": 2.0, "b": 3.5, "d": 3.5}
    for i in "abcd":
        assert got[1, i].fused == pytest.approx((2 * ndist.inv_cdf((p1[i] - 0.5) / 4) + ndist.inv_cdf((p2[i] - 0.5) / 4)) / 3, abs=1e-6)
    order = sorted("abcd", key=lambda i: (-got[1, i].fused, i))
    assert [got[1, i].position for i in order] == [1, 2, 3, 4] and got[2, "z"].fused == pytest.approx(0, abs=1e-9)
    assert (got[1, "a"].greater_g, got[1, "a"].greater_k, got[1, "c"].greater_g) == (2, 0, 3)
    assert rankfuse.fused_ranking(df.limit(0), "q", "item", ["g", "k"], "at").count() == 0


# markup


KINDS = [
    ("<p>One</p><ul><li>a</li></ul>", ["html"]), ("R&amp;D", ["html"]), ("a &nbsp b", ["html"]), ("x <!-- c --> y", ["html"]), ("# Head\ntext", ["markdown"]), ("Head\n----\ntext", ["markdown"]), ("a *b* c", ["markdown"]),
    ("a `b` c", ["markdown"]), ("[t](u)", ["markdown"]), ("see [t][4]", ["markdown"]), ("[4]: https://x.example", ["markdown"]), ("a[^1] b", ["markdown"]), ("> quoted", ["markdown"]), ("- [x] done", ["markdown"]),
    ("|---|---|", ["markdown"]), ("~~gone~~", ["markdown"]), ("== Head ==", ["wiki"]), ("a [[b|c]] d", ["wiki"]), ("a ''b'' c", ["wiki"]), ("{{stub|x}}", ["wiki"]), ("{| class=x\n|-\n|}", ["wiki"]), ("__TOC__", ["wiki"]),
    ("[https://x.example label]", ["wiki"]), ("\\section{A}", ["latex"]), ("a $x_1 \\le 2$ b", ["latex"]), ("\\(a^2\\)", ["latex"]), ("tuned\\footnote{D.} x", ["latex"]), ("$$a$$", ["latex"]),
    ("* item\n+ item\n1. item\n    code", []), ("Keep a < 3 and b > 4", []), ("R&D asked a == b, a != b", []), ("[[0, 1], [2, 3]]", []), ("__main__ x_init_y", []), ("THE __MAIN__ MODULE", []), ("#12 and 2 * 3 * 4", []), ("C:\\a\\b or D:\\c", []),
    ("Map<Key, List<Row>>", []), ("$5 to $10", []), ("x | y ~16%", []), ("[config]\nkey = 1", []), ("$ make x", []), ("Home > a > b", []), ("", []),
]


@pytest.mark.parametrize(("text", "kinds"), KINDS)
def test_kinds(text, kinds):
    got, plain = markup.convert(text)
    assert got == kinds and (kinds or plain == text)


def test_clean_keeps_structure():
    c = lambda t: markup.convert(t)[1]
    assert c("# Head\n\nA **b** `c_d` [e](f).\n\n```py\nx = *y*\n```\n- [x] i\n> q") == "Head\n\nA b c_d e.\n\n    x = *y*\n\n- i\nq"
    assert c("<h1>T</h1><p>a <b>b</b> &lt; c</p><ul><li>i</li></ul><pre><code>x  y\n z</code></pre><p>m</p>") == "T\n\na b < c\n\n- i\n\n    x  y\n     z\n\nm"
    assert c("== H ==\n''a'' [[b|c]] {{term|d}}\n{{code|1=x = 1\n}}\n* [[i]]") == "H\na c d\n\n    x = 1\n\n* i"
    assert c("\\section{S}\nA \\emph{b}~\\cite{c} $x_1 \\le 2$.\n\\begin{itemize}\n\\item i\n\\end{itemize}") == "S\nA b x_1 \\le 2.\n- i"
    assert c("plain * text\r\n") == "plain * text\r\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Put it in a `<script>` block. Then save.\n\nMore.", "Put it in a <script> block. Then save.\n\nMore."), ("A <script> block.\n<p>More</p>", "A  block.\n\nMore\n"), ("See `<b>` and *this* <i>one</i>", "See <b> and this one"),
        ("Use <style> so.<br>Then <style>p {}</style> and <template>a<template>b</template>c</template> end", "Use  so.\nThen  and  end"), ("<p>a</p><script>var x = '<b>';</script><p>b</p>", "a\n\nb"),
    ],
)
def test_silent_only_where_closed(text, want):
    assert markup.convert(text)[1] == want.strip("\n")


def test_any_nesting():
    deep = "core"
    for k in range(12):
        deep = f"\\emph{{{deep}}}" if k % 2 else f"\\textbf{{a {deep}}}"
    assert markup.convert(deep) == (["latex"], "a a a a a a core")
    assert markup.convert("{{a" * 12 + "}}" * 12 + "x") == (["wiki"], "x")
    assert markup.convert("[" * 5 + "t" + "](u)" * 5) == (["markdown"], "t")
    assert markup.convert("<div>" * 3000 + "text" + "</div>" * 3000) == (["html"], "text")


@pytest.mark.parametrize("text", ["<p>a" * 60_000, "<b>a" * 60_000, "<div>a" * 30_000, "</b>" * 60_000, "<!--" * 60_000, "__a " + "b " * 60_000, "== a" + " b" * 60_000, "$a = " + "b = " * 60_000, "\\x{} " + "a & b " * 30_000, "[" * 60_000, "{{" * 60_000, "*a" * 60_000, "''a " * 60_000], ids=range(13))
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    markup.convert(text)
    assert time.perf_counter() - began < 8


def test_kinds_are_what_was_taken():
    """No kind without a change: a text with a kind loses its construct, one without stays as it is."""
    for text, kinds in KINDS:
        got, plain = markup.convert(text)
        assert bool(got) == bool(kinds) and (plain != text) >= bool(kinds and "html" in kinds)


def test_consensus_paths(spark):
    page = '<div class="nav1"><a href="/a">Home</a> <a href="/b">Docs</a></div><div class="main"><p>Real text {}</p></div>'
    rows = [(f"p{i}", "Host", page.format(i).replace("nav1", f"nav{i}")) for i in range(6)] + [("n", "host", None), (None, "host", "x"), ("e", None, ""), ("p0", "host", page.format(0)), ("l", "host", "<b>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, own string, body string, text string")
    got = {r.id: r for r in markup.clean_texts(df, "id", "own", "body").collect()}
    assert got["p3"].body == "Real text 3" and got["p3"].kinds == ["html"] and got["n"].body is None and got["n"].kinds == [] and got["e"].body == ""
    assert got["l"].body.split() == ["word"] * 50_000 and set(got) == {"p0", "p1", "p2", "p3", "p4", "p5", "n", "e", "l"}
    assert markup.clean_texts(df.limit(0), "id", "own", "body").count() == 0


def test_any_number_of_paths_may_lose(spark, monkeypatch):
    nav = "".join(f'<div class="n{{}}{"abcdefghijklmnopqrstuvwxyz"[k]}"><a href="/">Menu</a></div>' for k in range(26))
    named = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03}")
    rows = [(i, "host", nav.replace("{}", named(i)) + f"<p>Real text {i}</p>") for i in range(50)]
    rows.append((50, "host", '```\n<div class="x">\n```\n<div class="naaaa"><a href="/">Menu</a></div><p>Real text 50</p><p>*b*</p>'))
    df = spark.createDataFrame(rows, "id int, own string, body string")
    want = {i: f"Real text {i}" for i in range(50)} | {50: '    <div class="x">\n\nReal text 50\n\nb'}
    assert {r.id: r.body for r in markup.clean_texts(df, "id", "own", "body").collect()} == want
    monkeypatch.setattr(markup, "if_small", lambda df: df)
    assert {r.id: r.body for r in markup.clean_texts(df, "id", "own", "body").collect()} == want


# packing


def test_pack(spark):
    rng = random.Random(5)
    sizes = [rng.choice([10, 300, 700, 1000, 1025, 2048]) + rng.randrange(200) for _ in range(700)] + [0, None, 5000, 2048, 4096, 1]
    df = spark.createDataFrame([(i % 690, s, 9) for i, s in enumerate(sizes)], "id int, size int, shard int")
    rows = packing.pack(df, "id", "size", 2048, shard_items=100).collect()
    fill = collections.Counter()
    whole = collections.Counter()
    for r in rows:
        fill[r.container] += r.piece_size
        whole[r.id] += r.piece_size
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(s or 0 for s in sizes)
    want = collections.Counter()
    for i, s in enumerate(sizes):
        want[i % 690] += s or 0
    assert +whole == +want and all(r.piece == 0 for r in rows if r.size <= 2048)
    assert len(fill) <= 1.06 * sum(fill.values()) / 2048 + 1
    assert packing.pack(df.limit(0), "id", "size", 2048).count() == 0


def test_local_search_empties_bins():
    for sizes, bins, cap, least in (
        ([6, 5, 5, 4], [[0], [1], [2], [3]], 10, 2),  # moves
        ([7, 4, 6, 3], [[0], [1, 3], [2]], 10, 2),  # one for one
        ([8, 3, 3, 4, 2], [[1, 2, 4], [3], [0]], 10, 2),
        ([1] * 100 + [150], [list(range(100)), [100]], 200, 2),
        ([10] * 90 + [3, 4, 987], [list(range(92)), [92]], 1000, 2),  # a bin of more items than any fixed limit
    ):
        got = packing.empty_bins([list(b) for b in bins], sizes, cap, 1.0)
        assert len(got) == least and sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= cap for b in got)


# mixing


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", " A ", "b", "c", "x", None]), rng.randint(1, 400)) for i in range(3000)]
    targets = spark.createDataFrame([("A", 30.0, 4), ("b", 5.0, 1), ("c", 60.0, 2), ("none", 5.0, 3), ("zero", 0.0, 1), (None, 5.0, 1)], "source string, w double, r int")
    t = mixing.targets_of(targets, "source", "w", "r")
    sized = spark.createDataFrame(docs, "key int, s string, size int").select("key", mixing.source_name(F.col("s")).alias("name"), "size")
    sized = sized.join(t.select("name"), "name", "left_semi").select("key", "name", "size")
    plan = mixing.budgets(sized, t).cache()
    uses = mixing.mix(sized, plan).collect()
    size, drawn, most = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in uses:
        size[r.name] += r.size
        drawn[r.name] += r.size * r.uses
        most[r.name].append(r.uses)
    total = sum(size.values())
    report = {r.source: r for r in mixing.shares(mixing.mix(sized, plan), plan).collect()}
    assert set(report) == {"A", "b", "c", "none"} and len(uses) == sum(1 for d in docs if d[1] and d[1].strip().lower() in "abc")
    for source, w, r in (("A", 30, 4), ("b", 5, 1), ("c", 60, 2), ("none", 5, 3)):
        name = source.lower()
        target = w / 100 * total
        assert report[source].short == (target > size[name] * r)
        if report[source].short:
            assert drawn[name] == size[name] * r
        else:
            assert abs(drawn[name] - target) <= 200 and max(most[name]) <= r
        assert report[source].drawn == drawn[name]
    nested = mixing.budgets(sized, t, (total / 10, total / 3, None, 3.0 * total)).cache()
    drawn_of = {(r.key, r.budget): r.uses for r in mixing.mix(sized, nested).collect()}
    assert all(drawn_of[k, b] <= drawn_of[k, b + 1] for k, _ in drawn_of for b in range(3)) and {(r.key, 2): r.uses for r in uses}.items() <= drawn_of.items()
    for r in mixing.shares(mixing.mix(sized, nested), nested).collect():
        assert r.short == (r.target > r.tokens * r.repeats) and (r.short or abs(r.drawn - r.target) <= 200)
    empty = sized.limit(0)
    none = mixing.budgets(empty, t).cache()
    assert mixing.mix(empty, none).count() == 0 and {(r.drawn, r.actual_share) for r in mixing.shares(mixing.mix(empty, none), none).collect()} == {(0, 0.0)}


# quality


COMMON = [("en", w) for w in "the and of to in a is that for it as with on are this".split()] + [("de", w) for w in "der die das und in zu den mit".split()]
PROSE = "The museum keeps its maps in a long hall. It is open to all of the visitors\nthat come with a ticket. this line has no capital and that is fine."


@pytest.mark.parametrize(
    ("text", "natural"),
    [
        (PROSE, True), ("Home\nDocs\nAbout\n\n" + PROSE, True), ("- red arena for maps\n- blue arena for the logs\n- green client", False), ("lol lol lol lol lol lol.", False), ("| a | b |\n|---|---|\n| 1 | 2 |", False),
        ('{"a": 1, "b": [1, 2, 3]}', False), ("这是一个很长的句子，里面没有空格。第二个句子也在这里。", True), ("budget linter vector agent " * 20, False), ("-=-=-=-=-=\n______", False), ("https://a.example/b/1\nhttps://c.example/d/2", False),
    ],
)
def test_sentences(text, natural):
    common = frozenset(w for _, w in COMMON)
    assert (quality.sentence_characters(text, common) / len("".join(text.split())) >= 0.5) == natural


def test_quality(spark):
    rows = [(i, PROSE + f" And the number of maps is {i}.", "EN") for i in range(30)] + [(100, "x = 1\ny = 2\n" * 5, "en-GB"), (101, None, "en"), (102, " \n", "en"), (103, PROSE, None), (None, PROSE, "en"), (104, "a " * 100_000, "en")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, lang string, language string")
    stats = quality.text_statistics(df, spark.createDataFrame(COMMON, "lang string, word string"))
    got = {r.doc_id: r for r in quality.quality(stats).collect()}
    assert set(got) == {*range(30), 100, 103, 104} and not got[100].natural and got[5].natural and got[100].outlier > got[5].outlier
    r = got[5]
    assert (r.n_words, r.closed_line_share) == (len(re.findall(r"[^\W\d_]+", rows[5][1])), 0.5) and 0 < r.symbol_share < 0.1
    assert quality.quality(quality.text_statistics(df.limit(0), spark.createDataFrame(COMMON, "lang string, word string"))).count() == 0


def test_each_language_is_ranked_by_itself(spark):
    rows = [(i, PROSE + f" And the number of maps is {i}.", "en") for i in range(8)] + [(i, "der die das " * (i - 7), "de") for i in range(8, 11)] + [(11, PROSE, None)]
    stats = quality.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(COMMON, "lang string, word string"))
    got = {r.doc_id: r for r in quality.quality(stats).collect()}
    assert {(r.language, r.n_total) for r in got.values()} == {("en", 8), ("de", 3), ("und", 1)}
    # n_words differs in all three German texts, the rest is equal: the shortest and the longest have a tail of a third
    assert [got[i].outlier for i in (8, 9, 10, 11)] == pytest.approx([math.log(3), -math.log(2 / 3), math.log(3), 0])
    assert [got[i].bound for i in (0, 8, 11)] == [None, 0, None] and sorted(i for i, r in got.items() if not r.natural) == [8, 9, 10]


def test_long_list_is_read_in_linear_time():
    import time

    began = time.perf_counter()
    assert quality.sentence_characters("green client\n" * 60_000 + "the end.", frozenset(["the"])) < 100
    assert time.perf_counter() - began < 10


def test_longest_prose_equals_trying_each_line():
    rng = random.Random(4)
    common = frozenset(w for _, w in COMMON)
    words = ["the", "and", "map", "Hall", "x", "12", "==", "vector", "的", "个"]
    for _ in range(300):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 9))]
        assert quality._longest_prose(lines, common) == next((k for k in range(1, len(lines)) if quality._prose("\n".join(lines[k:]), common)), None)


def test_found_where_a_third_is_one_junk_text(spark, tmp_path):
    from termloom.llm import queries

    rows = [(i, PROSE + f" And the number of maps is {i}.", "en") for i in range(20)] + [(i, "x = 1\ny = 2", "en") for i in range(20, 30)] + [(30, "| a | b |", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(COMMON, "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    assert sorted(r.doc_id for r in queries.p10_found(spark, str(tmp_path)).collect()) == list(range(20, 31))
    for r in queries.p10_quality(spark, str(tmp_path)).collect():
        assert r.natural == (r.sentence_share >= 0.5) and r.outlier >= r.nats and (r.natural or r.outlier >= r.bound)


# tokens


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    given = [(1, "Hello world", "s"), (2, None, "s"), (3, "", None), (4, "word " * 20_000, "s")]
    got = {r.id: (r.n_tokens, r.src) for r in tokens.token_sizes(spark.createDataFrame(given, "id int, _t string, src string"), "id", "_t", ("src",)).collect()}
    assert got[1] == (2, "s") and got[2] == (0, "s") and got[3] == (0, None) and got[4][0] == 20_001
    text = "Naïve café — 東京 <|endoftext|> tabs\t\n"
    assert tokens.encoder().decode(tokens.encoder().encode_ordinary(text)) == text


# queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_llm_query(spark, name):
    from tests.test_queries import both
    from termloom.llm import queries

    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("p4_found", ["greater_tfidf", "n_less"]), ("p6_found", ["LN(", "POWER("]), ("p7_found", ["MapInArrow", "won"]), ("p8_found", ["piece"]), ("p9_found", ["uses", "md5(", "upto"]), ("p10_found", ["n_low", "n_less", "-LN("]),
    ],
)
def test_found_comes_through_the_method(spark, name, parts):
    """What the method computes is in the optimized plan: nothing of it was pruned as unused."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert all(p.lower() in plan.lower() for p in parts), plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_llm_query_runs(spark, name):
    from termloom.llm import queries

    rows = queries.QUERIES[name](spark, DATA).collect()
    assert len(rows) >= (0 if name == "p8_found" else 1) and len({repr(r) for r in rows}) == len(rows)
