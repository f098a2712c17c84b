import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import placement
from termloom.operators import crawl, frontier, heavy_keys, index, kv, mapreduce, search, status
from termloom.sources import pages as page_source
from termloom.sources import store

FRONTIER = "url string, status string, addedAt bigint, claimedAt bigint, error string, errorAt bigint"


def urls_of(spark, *u):
    return spark.createDataFrame([(x,) for x in u], "url string")


def test_frontier_script(spark):
    empty = spark.createDataFrame([], FRONTIER)
    one = frontier.with_added(empty, urls_of(spark, "https://a.example/1"), 1)
    rows = {(r.url, r.added, r.reason) for r in frontier.add(one, urls_of(spark, "https://a.example/1/", "not a url", "https://a.example/2", "https://a.example/2#x")).collect()}
    assert rows == {("https://a.example/1", False, "duplicate"), ("not a url", False, "invalid-url"), ("https://a.example/2", True, None), ("https://a.example/2", False, "duplicate")}
    batch = urls_of(spark, "https://a.example/2", "https://a.example/3", "https://a.example/4", "https://a.example/1", "x")
    assert frontier.add_batch(one, batch).first().asDict() == {"added": 3, "skipped": 2}
    four = frontier.with_added(one, batch, 2)
    got = frontier.claim(four, 2)
    after = frontier.with_claimed(four, got, 3)
    assert frontier.stats(after).first().asDict() == {"unseen": 2, "seen": 2, "error": 0, "total": 4}
    rest = frontier.claim(after, 10)
    assert rest.count() == 2 and rest.join(got, "url").count() == 0
    failed = spark.createDataFrame([("https://a.example/3", "timeout"), ("https://z.example/", None)], "url string, reason string")
    marked = {r.url: (r.status, r.error, r.errorAt) for r in frontier.mark_error(after, failed, 9).collect()}
    assert marked["https://a.example/3"] == ("error", "timeout", 9) and marked["https://z.example/"] == ("error", "unknown", 9)
    assert frontier.stats(empty).first().asDict() == {"unseen": 0, "seen": 0, "error": 0, "total": 0}
    assert frontier.add_batch(empty, spark.createDataFrame([], "url string")).first().asDict() == {"added": 0, "skipped": 0}


DOCS = "doc_key string, text string, repoOwner string, topics array<string>, isFork boolean, isArchived boolean, lowContent boolean, lastCommitDate string, fetchedAt bigint"


def corpus(spark):
    texts = {
        "https://engineering.fb.com/networking": "network protocol protocol network latency", "https://blog.cloudflare.com/http3": "network protocol",
        "https://netflix.example/c": "caching caching database latency", "https://amazon.example/d": "database latency", "https://stripe.com/blog/api-design": "protocol design",
    }
    return spark.createDataFrame([(k, t, None, None, None, None, None, None, 1) for k, t in texts.items()], DOCS)


def test_search_scores(spark):
    made = index.postings(corpus(spark)).cache()
    got = search.search("protocol", made, total_docs=5)
    assert [(r["url"], r["score"]) for r in got.results] == [("https://engineering.fb.com/networking", 0.815), ("https://blog.cloudflare.com/http3", 0.49), ("https://stripe.com/blog/api-design", 0.49)]
    assert got.totalMatches == 3 and got.results[0]["breakdown"] == {"tfidf": 1.0, "pagerank_global": 0.5, "pagerank_repoOwner": 0.5, "recency": 0.3}
    caching = search.search("caching database", made, total_docs=5)
    assert [(r["url"], r["score"]) for r in caching.results] == [("https://netflix.example/c", 0.815), ("https://amazon.example/d", 0.3209)]
    assert caching.results[0]["matchedTerms"] == ["cach", "databas"] and caching.results[0]["termDetails"]["cach"]["tf"] == 2
    assert search.search("the and or", made).results == [] and search.search("xyznonexistent", made).terms == ["xyznonexist"]
    batch = search.search_batch(spark.createDataFrame([(1, "protocol"), (2, "the"), (3, None)], "query_id long, query string"), made, 5, F.current_timestamp(), top_n=1)
    assert [(r.query_id, r.url) for r in batch.collect()] == [(1, "https://engineering.fb.com/networking")]


def test_pages_are_counted(spark):
    from termloom.api import Engine

    pages = spark.range(1200).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") < 1100, "protocol").otherwise("other").alias("term"))
    made = pages.selectExpr("term", "url", "1L AS tf", "null AS repoOwner", "array('t') AS topics", "false AS isFork", "false AS isArchived", "false AS lowContent", "null AS lastCommitDate").cache()
    idf = round(math.log(1201 / 1101), 4)
    for got in (search.search("protocol", made), Engine(made).search("protocol")):
        assert got.totalMatches == 1100 and got.results[0]["termDetails"]["protocol"]["idf"] == idf and got.results[0]["breakdown"]["tfidf"] == 1.0


def test_recency_and_penalties(spark):
    rows = spark.createDataFrame([("2025-01-01",), ("2023-07-03T12:00:00Z",), ("last week",), (None,), ("2028-01-01",), ("1999-01-01",), ("2025-13-99",)], "d string")
    got = [r[0] for r in rows.select(F.round(search.recency(F.col("d"), F.lit("2025-01-01").cast("timestamp")), 4)).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5, abs=0.001) and got[2:4] == [0.3, 0.3] and got[4] == 2.0 and got[5:] == [0.0, 0.3]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (None,), (0.2,)], "x double").select(search.link_score(F.col("x"))).collect()] == [0.5, 0.5, 0.2]


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.run_indexer(corpus(spark), path)["docs"] == 5
    made = index.read(spark, path)
    assert index.lookup(made, "protocol").count() == 3 and index.doc_frequency(made).where("term = 'latenc'").first().df == 3
    more = index.merge(made, index.lookup(made, "protocol").limit(1))
    assert index.lookup(more, "protocol").count() == 1 and index.lookup(more, "latenc").count() == 3
    assert index.postings(spark.createDataFrame([], DOCS)).count() == 0


def test_mapreduce_equals_native_index(spark):
    rows = corpus(spark).select(F.col("doc_key").alias("key"), F.col("text").alias("value"))
    got = mapreduce.map_reduce(rows, lambda k, v: [{w: k} for w in v.split()], lambda k, v: {"n": len(v)}, urls_of(spark, "https://amazon.example/d", "missing").toDF("key"))
    assert {r.key: json.loads(r.value)["n"] for r in got.collect()} == {"database": 1, "latency": 1}
    bad = mapreduce.map_reduce(rows, lambda k, v: 1 / 0, lambda k, v: v).collect()
    assert len(bad) == 5 and all("ZeroDivisionError" in r.error for r in bad)
    with pytest.raises(TypeError):
        mapreduce.map_pairs(rows, "not callable")


def test_kv_fold(spark):
    log = [("put", "a", "1", 0), ("append", "a", "2", 1), ("append", "b", "3", 2), ("del", "a", None, 3), ("append", "a", "4", 4), ("put", "c", "5", 5), ("del", "c", None, 6), ("del", "c", None, 7), ("put", None, "v", 8)]
    df = spark.createDataFrame([("g", k, op, v, s) for op, k, v, s in log], "gid string, key string, op string, value string, seq bigint")
    state = {r.key: (r["values"], r.is_list) for r in kv.fold(df).collect()}
    assert state == {"a": (["4"], True), "b": (["3"], True), hashlib.sha256(b'"v"').hexdigest(): (["v"], False)}
    assert sorted((r.key, r.seq, r.found) for r in kv.deletions(df).collect()) == [("a", 3, True), ("c", 6, True), ("c", 7, False)]


def test_placement(spark):
    nids = [hashlib.sha256(json.dumps({"ip": ip, "port": 1}, separators=(",", ":")).encode()).hexdigest() for ip in "abc"]
    keys = ["x", 'quote"d', "", "long" * 50]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", placement.get_id(F.col("k")).alias("kid"))
    arr = F.array(*[F.lit(n) for n in nids])
    rows = df.select("k", "kid", placement.naive_hash(F.col("kid"), arr).alias("n"), placement.consistent_hash(F.col("kid"), arr).alias("c"), placement.rendezvous_hash(F.col("kid"), arr).alias("r")).collect()
    for r in rows:
        kid = hashlib.sha256(json.dumps(r.k).encode()).hexdigest()
        s = sorted(nids)
        assert r.kid == kid and r.n == s[int(kid, 16) % 3] and r.c == next((n for n in s if n >= kid), s[0])
        assert r.r == max(nids, key=lambda n: hashlib.sha256(json.dumps(kid + n).encode()).hexdigest())


def test_key_codec(spark):
    rows = spark.createDataFrame([("a/b",), ("ü" * 70,)], "k string").select("k", kv.file_name(F.col("k")).alias("f")).withColumn("b", kv.key_of_file(F.col("f"))).collect()
    assert rows[0].f == b"a/b".hex() and rows[0].b == "a/b" and rows[1].f == "H" + hashlib.sha256(("ü" * 70).encode()).hexdigest() and rows[1].b is None


def test_schedule_and_rate_limit(spark):
    rows = spark.createDataFrame([("d", 0), ("d", 100), ("d", 5000), ("d", 5200), ("e", 50)], "dom string, t bigint")
    assert sorted((r.dom, r.t, r.start) for r in crawl.schedule(rows, "dom", "t").collect()) == [("d", 0, 0), ("d", 100, 1000), ("d", 5000, 5000), ("d", 5200, 6000), ("e", 50, 50)]
    assert sorted((r.dom, r.t, r.wait) for r in crawl.rate_limit(rows, "dom", "t").collect()) == [("d", 0, 0), ("d", 100, 900), ("d", 5000, 0), ("d", 5200, 800), ("e", 50, 0)]


def test_schedule_over_many_parts(spark):
    import random

    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"d{rng.randrange(4)}", rng.randrange(40) * 100, i) for i in range(500)] + [(None, 5, 500), (None, None, 501)]
    want, free = {}, {}
    for d, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0, r[2])):
        want[i] = max(t or 0, free.get(d, 0))
        free[d] = want[i] + 70
    df = spark.createDataFrame(rows, "dom string, t bigint, i int")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {r.i: r.start for r in crawl.schedule(df, "dom", "t", 70, ("i",)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert crawl.schedule(df.limit(0), "dom", "t").count() == 0


def test_mapreduce_combiner(spark):
    rows = spark.createDataFrame([(f"k{i}", "hot " * 30 + f"w{i % 7}") for i in range(300)], "key string, value string")
    count = lambda k, v: [{w: 1} for w in v.split()]
    add = lambda k, vs: sum(vs)
    plain = {r.key: r.value for r in mapreduce.map_reduce(rows, count, add).collect()}
    assert plain == {r.key: r.value for r in mapreduce.map_reduce(rows, count, add, combiner=add).collect()} and plain["hot"] == "9000"
    assert mapreduce.map_pairs(rows, count, add).where("key = 'hot'").count() <= rows.rdd.getNumPartitions()
    bad = mapreduce.map_reduce(rows, count, add, combiner=lambda k, vs: 1 / 0).where("key = 'hot'").collect()
    assert bad and all("ZeroDivisionError" in (r.error or "") for r in bad if r.error) and any(r.error for r in bad)


def test_search_of_many_terms(spark, monkeypatch):
    made = index.postings(corpus(spark)).cache()
    queries = spark.createDataFrame([(1, "network protocol latency database caching"), (2, "design")], "query_id long, query string")
    at = F.lit("2025-01-01").cast("timestamp")
    few = sorted(map(tuple, search.search_batch(queries, made, 5, at).select("query_id", "url", "rank", "score", "matchedTerms").collect()))
    monkeypatch.setattr(search, "SLOTS", 2)
    assert few == sorted(map(tuple, search.search_batch(queries, made, 5, at).select("query_id", "url", "rank", "score", "matchedTerms").collect())) and len(few) == 6
    whole = search.score(search.aggregate(search.matches(search.terms_of(queries), made, F.lit(5))), at)
    assert {(r.query_id, r.url): r.score for r in whole.collect()} == {(q, u): s for q, u, _, s, _ in few}


def test_fresh_urls_of_a_stream(spark, tmp_path):
    from termloom.streaming import pipelines

    for k, urls in enumerate((["https://a.example/1/", "https://a.example/1", "bad", None], ["https://a.example/1", "https://a.example/2", "https://a.example/3"])):
        urls_of(spark, *urls).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = pipelines.fresh_urls(pipelines.source(spark, f"{tmp_path}/in", 1), urls_of(spark, "https://a.example/3"), 7)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("https://a.example/1", "unseen", 7), ("https://a.example/2", "unseen", 7)]


def test_pages_of_any_depth():
    from termloom.functions import html

    deep = "<div>" * 5000 + "<p>in <b>the</b> deep</p>" + "</div>" * 5000
    fields = html.page_fields(f'<title>t</title><div id="readme">{deep}</div>', "https://h.example/o/r")
    assert fields["text"] == "in the deep" and fields["title"] == "t"


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ('<meta property="og:published_time" content="2024-01-02"><meta property="article:published_time" content="2024-03-15T10:00:00Z">', "2024-03-15T10:00:00.000Z"),
        ('<meta name="article:published_time" content="2024-01-02">', None), ('<meta name="publish-date" content="15 March 2024">', "2024-03-15T00:00:00.000Z"), ('<meta name="publish_date" content="2024-01-02">', None),
        ('<meta name="DC.date" content="bad"><meta property="article:modified_time" content="Fri, 15 Mar 2024 10:00:00 GMT">', "2024-03-15T10:00:00.000Z"),
        ('<meta name="date" content="soon"><meta name="date" content="2024-01-02"><meta name="DC.date" content="2024-05-06">', "2024-05-06T00:00:00.000Z"), ('<time datetime="x"></time><time datetime="2024-01-01"></time><meta name="date" content="2024/02/03">', "2024-02-03T00:00:00.000Z"), ("", None),
    ],
)
def test_dates(head, want):
    from termloom.functions import html

    assert html.page_fields(head, "https://h.example/o/r")["published"] == want


def test_crawl_batch_and_loop(spark):
    web = spark.createDataFrame(
        [("https://a.example/1", "https://a.example/1", None, "t", ["https://a.example/2", "bad"]), ("https://a.example/2", "https://b.example/x", None, "t", []), ("https://a.example/3", None, "http-status", None, None)],
        "url string, final_url string, reason string, text string, links array<string>",
    )
    start = frontier.with_added(spark.createDataFrame([], FRONTIER), urls_of(spark, "https://a.example/1", "https://a.example/3", "https://a.example/4"), 0)
    seen = []
    after, docs, total = crawl.crawl_loop(start, web, 10, stop_when="idle", allowed=lambda u: u.startswith("https://a."), on_batch=seen.append)
    assert seen == [{"crawled": 1, "errors": 2, "linksFound": 1}, {"crawled": 0, "errors": 1, "linksFound": 0}, {"crawled": 0, "errors": 0, "linksFound": 0}]
    assert {r.url: r.error for r in after.where("status = 'error'").collect()} == {"https://a.example/2": "disallowed-redirect", "https://a.example/3": "http-status", "https://a.example/4": "not-found"}
    assert [r.doc_key for r in docs[0].collect()] == ["https://a.example/1"] and total["rounds"] == 3
    _, _, stop = crawl.crawl_loop(start, web, 1, max_pages=0)
    assert stop["rounds"] == 0


def test_topic_pages_cut(spark):
    link = lambda *p: "".join(f'<a href="/{x}">x</a>' for x in p)
    pages = [("t", 1, link("o/a", "Topics/x", "o/a/b")), ("t", 2, link("o/b")), ("t", 3, link("o/a")), ("t", 4, link("o/c")), ("u", 2, link("o/z"))]
    df = spark.createDataFrame(pages, "topic string, page int, html string")
    assert sorted(r.url for r in page_source.topic_pages(df, "https://h.example").collect()) == ["https://h.example/o/a", "https://h.example/o/b"]


def test_page_source_fetcher(spark):
    got = page_source.fetch(urls_of(spark, "https://a.example/", "https://b.example/"), lambda u: (u, u, 200, "text/html", 3, 0, "<p>", None), 2)
    assert sorted(r.url for r in got.where("status = 200").collect()) == ["https://a.example/", "https://b.example/"]
    page_source.register(spark)
    none = spark.read.format("pages").option("urls", "[]").load()
    assert none.count() == 0 and "final_url" in none.columns


def test_store(spark, tmp_path):
    path = str(tmp_path / "kv")
    store.write(spark.createDataFrame([("g", "a", "1"), ("h", "b", "2")], "gid string, key string, value string"), path)
    assert store.read_value(spark, path, "g", "a") == "1" and [r.key for r in store.keys(spark, path, "h").collect()] == ["b"]
    with pytest.raises(KeyError, match="Key not found"):
        store.read_value(spark, path, "g", "b")
    store.reset(spark, path, ["g"])
    assert store.scan(spark, path, "h").count() == 1


def test_gossip_targets(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(10)], "nid string")
    sent = status.gossip_targets(nodes).groupBy("from_nid").count().collect()
    assert len(sent) == 10 and {r["count"] for r in sent} == {3}


def test_key_statistics(spark):
    rows = [("hot", f"t{i % 50}", 1) for i in range(3000)] + [(f"k{i}", "t", None) for i in range(200)] + [("hot", None, 5), ("hot", "", 5), (None, "t", 2)]
    df = spark.createDataFrame(rows, "item string, n string, weight int")  # the columns' names are those used inside
    got = {r[0]: tuple(r)[1:] for r in heavy_keys.key_statistics(df, "item", "n", "weight").collect()}
    assert got["hot"] == (3002, 50, 3010) and got["k7"] == (1, 1, 0) and got[None] == (1, 1, 2) and len(got) == 202
    assert heavy_keys.key_statistics(df.limit(0), "item", "n", "weight").count() == 0
    assert [r[0] for r in heavy_keys.heavy_keys(df, "item").collect()] == ["hot"]


def test_as_of_is_a_parameter(spark):
    made = index.postings(corpus(spark).withColumn("lastCommitDate", F.lit("2024-01-01")))
    old = search.search("protocol", made, as_of=dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc))
    assert old.results[0]["breakdown"]["recency"] == 0.0
