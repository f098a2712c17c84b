"""Queries of the engine's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.durable import durable, scratch
from termloom.functions import html, placement, text, urls
from termloom.operators import crawl, frontier, index, kv, mapreduce, search, status
from termloom.operators import search_blocks as blocks
from termloom.sources import pages as page_source
from termloom.sources import store
from termloom.tables import load

AS_OF = "2025-01-01 00:00:00"
BASE = "https://code.example"
SUFFIXES = ["", "/", "/wiki", "/releases", "/blob/main/README.md", "/pulls", "/issues/1", "/tree/main"]
HREFS = ["https://other.example/a", "/rooted/path", "/x?b=1"]
NODES = [("10.0.0.1", 8080), ("10.0.0.2", 8080), ("10.0.0.3", 8080), ("10.0.0.4", 8080)]
NOW = 1_800_000_000_000


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "frontier").select("url").where("url IS NOT NULL").distinct()


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return index.pages(load(spark, sf, "docs"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "hits").where("query_id IS NOT NULL").groupBy("query_id").agg(F.max("query").alias("query"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return index.current_postings(load(spark, sf, "postings"))


def _n_docs(spark: SparkSession, sf: str):
    """The number of pages there are, as a part of the plan."""
    return load(spark, sf, "docs").agg(F.countDistinct("doc_key").alias("n")).scalar()


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# text


def a1_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _pages(spark, sf).select("doc_key", F.posexplode(text.kept_tokens(F.col("text"))).alias("pos", "token"))
    return text.stemmed(tokens).select("doc_key", "pos", "term")


def a2_stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = _pages(spark, sf).select(F.explode(text.raw_tokens(F.col("text"))).alias("token"))
    return raw.where(~text.is_stopword(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def a3_stem_vocab(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _pages(spark, sf).select(F.explode(text.raw_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", text.stem(F.col("token")).alias("term"))


def a4_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return text.term_counts(_pages(spark, sf), "doc_key", "text")


def a5_process_text(spark: SparkSession, sf: str) -> DataFrame:
    counts = text.term_counts(_pages(spark, sf), "doc_key", "text")
    return counts.groupBy("doc_key").agg(F.sum("tf").alias("n_terms"), F.count(F.lit(1)).alias("n_distinct"), F.max("tf").alias("most"))


def a6_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.terms_of(_queries(spark, sf))


def a8_round4(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "hits").where("tfidf IS NOT NULL").select("query_id", "url", text.round4(F.col("tfidf")).alias("r"))


def a9_ln_idf(spark: SparkSession, sf: str) -> DataFrame:
    df = index.doc_frequency(_index(spark, sf))
    return df.select("term", "df", F.round(text.ln_idf(_n_docs(spark, sf), F.col("df")), 8).alias("idf"))


# URLs


def b1_normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("url", urls.normalize_url(F.col("url")).alias("normal"))


def b2_company_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("url", urls.company_tag(F.col("url")).alias("tag"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = F.explode(F.array(*[F.lit(p) for p in ("", "/", "/blog/1", "/technology", "/News", "/careers")])).alias("p")
    hosts = load(spark, sf, "docs").where("url IS NOT NULL").select(urls.url_host(F.col("url")).alias("h")).distinct()
    return hosts.select("h", paths).select(F.concat(F.lit("https://www."), "h", "p").alias("url"))


def b3_allowed_path(spark: SparkSession, sf: str) -> DataFrame:
    both = _paths(spark, sf).unionByName(_urls(spark, sf))
    return both.select("url", urls.has_allowed_path(F.col("url")).alias("ok"))


def b4_domain_allowed(spark: SparkSession, sf: str) -> DataFrame:
    both = _paths(spark, sf).unionByName(_urls(spark, sf))
    return both.select("url", urls.is_domain_allowed(F.col("url"), ["code.example", "mill.example"]).alias("ok"))


def b5_policy(spark: SparkSession, sf: str) -> DataFrame:
    both = _paths(spark, sf).unionByName(_urls(spark, sf))
    return both.select("url", urls.Policy(["CODE.example"]).is_allowed(F.col("url")).alias("ok"))


def b6_create_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A policy of a list, which is lower-cased, and one of a set, which is not."""
    listed, as_is = urls.Policy(["CODE.example", "mill.EXAMPLE"]), urls.Policy({"CODE.example", "mill.example"})
    both = _paths(spark, sf).unionByName(_urls(spark, sf))
    return both.select("url", listed.is_domain_allowed(F.col("url")).alias("listed"), as_is.is_domain_allowed(F.col("url")).alias("as_is"))


def b7_repo_url_policy(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("doc_key", "^https?://[^/]+", "https://github.com")
    made = load(spark, sf, "docs").select(path.alias("p")).distinct().select("p", F.explode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("s")).select(F.concat("p", "s").alias("url"))
    return made.where("url IS NOT NULL").select("url", urls.repo_url_allowed(F.col("url")).alias("ok"))


def b8_resolve_link(spark: SparkSession, sf: str) -> DataFrame:
    made = load(spark, sf, "docs").select("url").distinct().select("url", F.explode(F.array(*[F.lit(h) for h in HREFS])).alias("href"))
    return made.select("url", "href", urls.resolve_link(F.col("url"), F.col("href")).alias("target"))


def b9_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select(urls.url_host(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def b10_path_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("url", urls.path_segment(F.col("url"), 3).alias("owner"), urls.path_segment(F.col("url"), 4).alias("name"))


# HTML and seeding


def c3_title(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "seed_pages").select("url", html.title_of(F.col("html")).alias("title"))


def c4_links(spark: SparkSession, sf: str) -> DataFrame:
    linked = load(spark, sf, "seed_pages").select("url", F.posexplode(html.links_of(F.col("html"), F.col("url"))).alias("pos", "raw"))
    return linked.select("url", "pos", urls.normalize_url(F.col("raw")).alias("link"))


def c6_parse_page(spark: SparkSession, sf: str) -> DataFrame:
    parsed = load(spark, sf, "seed_pages").select("url", html.parse_page(F.col("html"), F.col("url")).alias("p"))
    return parsed.select("url", "p.title", "p.repoOwner", "p.lowContent", F.size("p.links").alias("n_links"), F.length("p.text").alias("n_text"))


def _made_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page, url): repository pages with every kind of description, README and metadata, from the documents' ids."""
    k = F.pmod(F.col("doc_id"), F.lit(20_000))
    n = k.cast("string")
    when = lambda test, *parts: F.when(test, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")
    parts = [
        when(k % 4 == 2, '<meta property="og:description" content="D', n, '">'), when(k % 4 == 0, '<p class="f4 my-3"> D', n, " </p>"), when(k % 4 == 1, '<div class="Layout-sidebar"><p>D', n, "</p></div>"),
        when(k % 3 == 0, '<div id="readme"><p>Read ', n, "</p><ul><li>one</li></ul></div>"), when(k % 3 == 1, '<article class="markdown-body">A long text on page ', n, "</article>"),
        F.repeat(F.concat(F.lit('<a class="topic-tag"> t'), n, F.lit(" </a>")), (k % 3).cast("int")), when(k % 5 == 0, '<span id="repo-stars-counter">', n, "</span>"), when(k % 2 == 0, '<li class="d-inline"><a><span class="color-fg-default">L', n, "</span></a></li>"),
        when(k % 7 == 0, '<span class="text-small">Forked from x/y</span>'), when(k % 11 == 0, '<div class="archived-notice">This was archived</div>'), when(k % 13 == 0, '<relative-time datetime="2024-01-01">x</relative-time>'),
    ]
    return load(spark, sf, "documents").select("doc_id", F.concat(*parts).alias("page"), F.concat(F.lit("https://code.example/o"), n, F.lit("/r"), n).alias("url"))


def c1_text(spark: SparkSession, sf: str) -> DataFrame:
    return _made_pages(spark, sf).select("doc_id", html.parse_page(F.col("page"), F.col("url"))["text"].alias("text"))


def c5_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = _made_pages(spark, sf).select("doc_id", html.parse_page(F.col("page"), F.col("url")).alias("p"))
    return rows.select("doc_id", "p.repoOwner", "p.repoName", "p.description", "p.language", F.array_join("p.topics", ",").alias("topics"), "p.stars", "p.lastCommitDate", "p.isFork", "p.isArchived", "p.lowContent")


_DATES = ["2024-03-15T10:00:00Z", "2024-03-15", "Fri, 15 Mar 2024 10:00:00 +0200", "March 15, 2024", "soon", ""]


def c2_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made from the documents, each with a time and every kind of date meta, of which some hold no date."""
    k = F.pmod(F.col("doc_id"), F.lit(20_000))
    date = lambda i: F.element_at(F.array(*[F.lit(d) for d in _DATES]), (F.pmod(F.floor(k / 3**i), F.lit(len(_DATES))) + 1).cast("int"))
    metas = [("property", "article:published_time"), ("property", "og:published_time"), ("name", "date"), ("name", "publish-date"), ("name", "DC.date"), ("property", "article:modified_time"), ("name", "article:published_time"), ("property", "date")]
    # the last meta comes first in the page: the order of kinds counts, not that of places
    parts = [F.when(k % (i + 2) == 0, F.concat(F.lit(f'<meta {a}="{n}" content="'), date(i), F.lit('">'))).otherwise("") for i, (a, n) in enumerate(metas)]
    time = F.when(k % 7 == 0, F.concat(F.lit('<p><time datetime="'), date(7), F.lit('">x</time>'))).otherwise("")
    page = F.concat(F.lit("<html><head>"), *reversed(parts), F.lit("</head><body>"), time, F.lit("</body></html>"))
    return load(spark, sf, "documents").select("doc_id", html.parse_page(page, F.lit("https://code.example/o/r"))["published"].alias("published"))


def c7_repo_links(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "seed_pages").select("url", F.posexplode(html.repo_links_of(F.col("html"), BASE)).alias("pos", "repo"))


def d1_fetch_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce("addedAt", F.lit(0))
    made = load(spark, sf, "frontier").select(
        "url", F.when(k % 7 == 0, 404).otherwise(200).alias("status"), F.when(k % 5 == 0, "image/png").when(k % 5 == 1, "application/xhtml+xml").otherwise("Text/HTML; charset=utf-8").alias("ct"),
        (k % 4_000_000).alias("size"), (k % 8).cast("int").alias("redirects"),
    )
    verdict = crawl.fetch_verdict(F.col("status"), F.col("ct"), F.col("size"), F.col("redirects"))
    return made.groupBy(F.coalesce(verdict, F.lit("ok")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def d3_topic_pages(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.topic_pages(load(spark, sf, "seed_pages"), BASE)


def d4_trending(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories on trending pages, for which the listing pages stand in; every fifth page failed."""
    got = load(spark, sf, "seed_pages").select("url", F.when(F.col("page") % 5 == 0, 500).otherwise(200).alias("status"), "html")
    return page_source.trending_repos(got, BASE)


def d6_seed_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "seed_pages")
    known = frontier.current(load(spark, sf, "frontier"))
    return page_source.seed_frontier(known, pages, pages.select("url", F.lit(200).alias("status"), "html"), BASE, NOW, 3)[1]


def d5_seed_union(spark: SparkSession, sf: str) -> DataFrame:
    found = page_source.seed_urls(load(spark, sf, "seed_pages"), BASE)
    known = frontier.current(load(spark, sf, "frontier"))
    return frontier.add_batch(known, found).withColumn("discovered", F.col("added") + F.col("skipped"))


def d8_store_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "store")
    rows = load(spark, sf, "customer").select("c_mktsegment", F.col("c_name").alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    store.write(rows.withColumnRenamed("c_mktsegment", "gid"), path)
    return store.keys(spark, path, "BUILDING")


def d9_store_get(spark: SparkSession, sf: str) -> DataFrame:
    """A collection's values, after another one was dropped."""
    path = scratch(spark, "store")
    store.write(load(spark, sf, "customer").select(F.col("c_mktsegment").alias("gid"), F.col("c_name").alias("key"), F.col("c_custkey").cast("string").alias("value")), path)
    store.reset(spark, path, ["MACHINERY"])
    return store.scan(spark, path, "BUILDING").unionByName(store.scan(spark, path, "MACHINERY")).select("gid", "key", "value")


# frontier


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    links = load(spark, sf, "docs").select(F.explode("links").alias("url"))
    return links.unionByName(spark.createDataFrame([("not a url",), ("mailto:a@b",)], "url string"))


def e1_frontier_add(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.add(frontier.current(load(spark, sf, "frontier")), _incoming(spark, sf))


def e2_add_batch(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.add_batch(frontier.current(load(spark, sf, "frontier")), _incoming(spark, sf))


def e3_claim(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.claim(frontier.current(load(spark, sf, "frontier")), 100, "7")


def e4_mark_error(spark: SparkSession, sf: str) -> DataFrame:
    now = frontier.current(load(spark, sf, "frontier"))
    failed = now.where("status = 'seen'").select("url", F.lit("timeout").alias("reason")).unionByName(spark.createDataFrame([("https://new.example/", None)], "url string, reason string"))
    return frontier.mark_error(now, failed, NOW).select("url", "status", "error", "errorAt")


def e5_stats(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.stats(frontier.current(load(spark, sf, "frontier")))


def e6_get(spark: SparkSession, sf: str) -> DataFrame:
    known = frontier.current(load(spark, sf, "frontier"))
    one = known.agg(F.min("url").alias("url")).first()[0]
    return frontier.get(known, one).select("url", "status")


# crawl


def f1_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return crawl.rate_limit(asked, "user_id", "arrival", 3_600_000, ("event_id",))


def f2_schedule(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return crawl.schedule(asked, "user_id", "arrival", 3_600_000, ("event_id",)).select("event_id", "user_id", "arrival", "start")


def f4_crawl_batch(spark: SparkSession, sf: str) -> DataFrame:
    known = frontier.current(load(spark, sf, "frontier"))
    page = load(spark, sf, "docs").groupBy("doc_key").agg(F.max(F.struct("fetchedAt", "links", "text")).alias("m"))
    had = page.select(F.col("doc_key").alias("url"), F.col("doc_key").alias("final_url"), F.lit(None).cast("string").alias("reason"), "m.text", "m.links")
    _, _, summary = crawl.crawl_batch(known, had, 500, "7", NOW)
    return summary


def f3_crawl_one(spark: SparkSession, sf: str) -> DataFrame:
    """Every URL of the frontier fetched by a stand-in for the network, judged and parsed."""
    fetched = page_source.fetch(_urls(spark, sf), _stand_in, 8)
    allowed = lambda u: ~urls.url_path(u).contains("/x")
    return page_source.judged_pages(fetched, allowed).select("url", "final_url", "reason", "title", "text", F.array_join("links", " ").alias("links"))


def _stand_in(url: str) -> tuple:
    """What a fetch would give: decided by the length of the URL."""
    n = len(url)
    if n % 11 == 0:
        return url, None, None, None, 0, 0, None, "timed out"
    page = f'<title>{n}</title><article class="markdown-body"><p>read {n}</p></article><a href="/a/{n}">x</a>'
    return url, f"https://code.example/{'x' if n % 5 == 0 else 'o'}/{n}", 404 if n % 7 == 0 else 200, "image/png" if n % 6 == 0 else "text/html", 3_000_000 if n % 13 == 0 else n, n % 8, page, None


def f7_crawl_until_idle(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of the production size over the whole frontier until one finds nothing to do."""
    known = frontier.current(load(spark, sf, "frontier"))
    page = load(spark, sf, "docs").where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.max("links").alias("links"))
    had = durable(page.select(F.col("doc_key").alias("url"), F.col("doc_key").alias("final_url"), F.lit(None).cast("string").alias("reason"), "links"))
    unseen = known.where("status = 'unseen'").count()
    after, _, _ = crawl.crawl_loop(known, had, max(1000, unseen), stop_when="idle", now=NOW)
    return frontier.stats(after)


def f9_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    one = load(spark, sf, "docs").groupBy("doc_key").agg(F.max("links").alias("links"))
    return crawl.link_graph(one.where("doc_key IS NOT NULL"))


def f5_link_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A round over the whole frontier that follows only links which a rule lets through."""
    known = frontier.current(load(spark, sf, "frontier"))
    page = load(spark, sf, "docs").where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.max("links").alias("links"))
    had = page.select(F.col("doc_key").alias("url"), F.col("doc_key").alias("final_url"), F.lit(None).cast("string").alias("reason"), "links")
    return crawl.crawl_batch(known, had, known.count(), "7", NOW, link_filter=lambda u: F.length(u) % 2 == 0)[2]


def f6_crawl_rounds(spark: SparkSession, sf: str) -> DataFrame:
    known = frontier.current(load(spark, sf, "frontier"))
    page = load(spark, sf, "docs").groupBy("doc_key").agg(F.max(F.struct("fetchedAt", "links", "text")).alias("m"))
    had = page.select(F.col("doc_key").alias("url"), F.col("doc_key").alias("final_url"), F.lit(None).cast("string").alias("reason"), "m.text", "m.links")
    after, _, _ = crawl.crawl_loop(known, had, 50, rounds=2, stop_when="never", now=NOW)
    return frontier.stats(after)


# map-reduce


def _count_words(key: str, value: str):
    import re

    return [{w: 1} for w in re.findall("[a-z]+", (value or "").lower())]


def _sum(key: str, values: list):
    return {"key": key, "n": sum(values)}


def g1_mapreduce_generic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf).select(F.col("doc_key").alias("key"), F.col("text").alias("value"))
    made = mapreduce.map_reduce(rows, _count_words, _sum, combiner=lambda key, values: sum(values))
    return made.select("key", F.get_json_object("value", "$.n").cast("bigint").alias("n"))


def _posting_pairs(key: str, value: str):
    import re
    from collections import Counter

    return [{w: {"url": key, "tf": n}} for w, n in Counter(re.findall("[a-z]+", (value or "").lower())).items()]


def _add_up(key: str, values: list):
    return {"df": sum(v.get("df", 1) for v in values), "total": sum(v.get("total", v.get("tf")) for v in values)}


def g7_mr_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf).select(F.col("doc_key").alias("key"), F.col("text").alias("value"))
    made = mapreduce.map_reduce(rows, _posting_pairs, _add_up, combiner=_add_up)
    return made.select(F.col("key").alias("token"), F.get_json_object("value", "$.df").cast("bigint").alias("df"), F.get_json_object("value", "$.total").cast("bigint").alias("total"))


def g2_order_lists(spark: SparkSession, sf: str) -> DataFrame:
    per = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))
    return per


# index


def h1_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.postings(load(spark, sf, "docs")).withColumn("topics", F.array_join("topics", ","))


def h2_inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    nested = index.inverted(index.postings(load(spark, sf, "docs")).select("term", "url", "tf"))
    return nested.select("term", F.size("postings").cast("bigint").alias("n"), F.array_join(F.transform("postings", lambda p: F.concat(p["url"], F.lit(":"), p["tf"])), " ").alias("list"))


def h3_indexer_stats(spark: SparkSession, sf: str) -> DataFrame:
    made = index.postings(load(spark, sf, "docs"))
    return made.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))


def h4_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return index.lookup(_index(spark, sf), "worker").select("term", "url", "tf")


def h5_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_stats(_index(spark, sf))


def h6_doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return index.doc_frequency(_index(spark, sf))


# search


def _pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pagerank")


def _flat(rows: DataFrame) -> DataFrame:
    part = F.col("breakdown")
    return rows.select(
        "query_id", "rank", "url", "score", part["tfidf"].alias("tfidf"), part["pagerank_global"].alias("pagerank_global"), part["pagerank_repoOwner"].alias("pagerank_repoOwner"),
        part["recency"].alias("recency"), F.array_join("matchedTerms", " ").alias("matched"), "totalMatches",
    )


def _ranked(spark: SparkSession, sf: str, queries: DataFrame) -> DataFrame:
    terms = durable(search.terms_of(queries))
    near = durable(index.current_postings(load(spark, sf, "postings"), terms, combine=True))
    return _flat(search.search_batch(queries, near, _n_docs(spark, sf), _as_of(), _pagerank(spark, sf), terms=terms, near=near))


def i1_search(spark: SparkSession, sf: str) -> DataFrame:
    query = spark.createDataFrame([(1, "archived worker limits and files")], "query_id bigint, query string")
    words = [tuple(r) for r in search.terms_of(query).collect()]  # as many as one query has: they are pushed to the scan
    near = index.current_postings(load(spark, sf, "postings").where(F.col("term").isin([w for _, _, w in words])))
    terms = spark.createDataFrame(words, "query_id bigint, pos int, term string")
    return _flat(search.search_few(terms, near, _n_docs(spark, sf), _as_of(), _pagerank(spark, sf)))


def i1_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, _queries(spark, sf))


def _search_pages(spark: SparkSession, sf: str, meta: bool = False, links: bool = False) -> tuple[DataFrame, blocks.Batch]:
    """The pages with the queries' terms, and the queries; with ``meta`` the postings have what the penalties need, with ``links`` the pages their scores."""
    terms = durable(search.terms_of(_queries(spark, sf)))
    words = blocks.words_of(terms)
    batch = blocks.batch_of(terms, words)
    near = index.current_postings(load(spark, sf, "postings"), terms, None if meta else ())
    near = near.join(blocks.numbers(words, terms), "term")
    pages = blocks.pages_of(near.select("url", "t", "tf", *search.slim_meta(_as_of()) if meta else ()), "url")
    pages = durable(search.with_links(pages, _pagerank(spark, sf)) if links else pages)
    return pages, blocks.with_idf(batch, pages, _n_docs(spark, sf))


def i3_or_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.every(*_search_pages(spark, sf), lambda batch, part, b: [blocks.round4(b.x)], ["tfidf"], matched=True)


def i3_term_details(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.details(*_search_pages(spark, sf))


def i6_max_norm(spark: SparkSession, sf: str) -> DataFrame:
    pages, batch = _search_pages(spark, sf)
    return blocks.every(pages, blocks.with_best(pages, batch), lambda batch, part, b: [blocks.round4(blocks.norms(batch, b))], ["norm"])


def i7_penalties(spark: SparkSession, sf: str) -> DataFrame:
    pages, batch = _search_pages(spark, sf, meta=True)
    return blocks.every(pages, blocks.with_best(pages, batch), lambda batch, part, b: [blocks.round4(v) for v in blocks.parts(batch, b)], ["tfidf", "recency"])


def i8_blend(spark: SparkSession, sf: str) -> DataFrame:
    pages, batch = _search_pages(spark, sf, meta=True, links=True)
    return blocks.every(pages, blocks.with_best(pages, batch), blocks.scores(search.BLEND), ["score"])


def i9_topn(spark: SparkSession, sf: str) -> DataFrame:
    terms = durable(search.terms_of(_queries(spark, sf)))
    near = durable(index.current_postings(load(spark, sf, "postings"), terms, combine=True))
    best, pages = search.first_matches(terms, near, _n_docs(spark, sf), _as_of(), _pagerank(spark, sf), 5)
    return best.join(pages.select("uid", "url"), "uid").select("query_id", "rank", "url", "score")


def i4_recency(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "docs").select("lastCommitDate").distinct().select("lastCommitDate", text.round4(search.recency(F.col("lastCommitDate"), _as_of())).alias("recency"))


def i5_pagerank_join(spark: SparkSession, sf: str) -> DataFrame:
    one = _pagerank(spark, sf).groupBy("url").agg(F.max(F.struct("global", "repoOwner")).alias("m"))
    both = load(spark, sf, "docs").select(F.col("doc_key").alias("url")).distinct().join(one, "url", "left")
    return both.where("url IS NOT NULL").select("url", search.link_score(F.col("m.global")).alias("g"), search.link_score(F.col("m.repoOwner")).alias("o"))


def i10_total_matches(spark: SparkSession, sf: str) -> DataFrame:
    terms = durable(search.terms_of(_queries(spark, sf)))
    words = blocks.words_of(terms)
    # whichever state is the latest, the posting is there
    held = load(spark, sf, "postings").where("url IS NOT NULL").join(blocks.numbers(words, terms), "term").select("url", "t").distinct()
    pages = held.repartition("url").groupBy("url").agg(F.collect_list("t").alias("l")).select("l")
    return blocks.counts(durable(pages), blocks.batch_of(terms, words))


# key-value log


def _log(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("event_type") == "error", "del").otherwise("append")
    return load(spark, sf, "events").select(F.lit("g").alias("gid"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), op.alias("op"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))


def j1_kv_put(spark: SparkSession, sf: str) -> DataFrame:
    return kv.latest_puts(_log(spark, sf))


def j2_kv_get(spark: SparkSession, sf: str) -> DataFrame:
    return kv.get(kv.fold(_log(spark, sf)), "g", "u1").select("gid", "key", F.array_join("values", ",").alias("v"))


def j3_kv_keys(spark: SparkSession, sf: str) -> DataFrame:
    return kv.keys(kv.fold(_log(spark, sf)))


def j4_kv_del(spark: SparkSession, sf: str) -> DataFrame:
    return kv.deletions(_log(spark, sf)).groupBy("found").agg(F.count(F.lit(1)).alias("n"))


def j5_kv_append(spark: SparkSession, sf: str) -> DataFrame:
    return kv.fold(_log(spark, sf)).select("gid", "key", F.array_join("values", ",").alias("v"), "is_list")


def _nids(n: int):
    return F.array(*[placement.node_id(F.lit(ip), F.lit(port)) for ip, port in NODES[:n]])


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "docs").select(F.col("doc_key").alias("key")).where("key IS NOT NULL").distinct()


def j6_reconf_plan(spark: SparkSession, sf: str) -> DataFrame:
    return kv.movement_plan(_keys(spark, sf), placement.get_id(F.col("key")), _nids(3), _nids(4), placement.rendezvous_hash)


def j8_key_codec(spark: SparkSession, sf: str) -> DataFrame:
    both = _keys(spark, sf).select(F.explode(F.array("key", F.repeat("key", 6))).alias("key"))
    named = both.select("key", kv.file_name(F.col("key")).alias("name"))
    return named.withColumn("back", kv.key_of_file(F.col("name")))


def k1_get_id(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).select("key", placement.get_id(F.col("key")).alias("id"))


def k2_nid_sid(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark.createDataFrame(NODES, "ip string, port int").withColumn("nid", placement.node_id(F.col("ip"), F.col("port")))
    return nodes.withColumn("sid", placement.short_id(F.col("nid")))


def k3_message_id(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", placement.message_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_type")).alias("mid"))


def k5_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).select("key", placement.naive_hash(placement.get_id(F.col("key")), _nids(3)).alias("nid"))


def k6_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).select("key", placement.consistent_hash(placement.get_id(F.col("key")), _nids(3)).alias("nid"))


def k7_rendezvous(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).select("key", placement.rendezvous_hash(placement.get_id(F.col("key")), _nids(3)).alias("nid"))


def k9_load(spark: SparkSession, sf: str) -> DataFrame:
    return k7_rendezvous(spark, sf).groupBy("nid").agg(F.count(F.lit(1)).alias("n"))


# status


def l3_group_members(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "rem").otherwise("add")
    log = load(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("gid"), F.col("user_id").cast("string").alias("sid"), op.alias("op"), F.col("event_id").alias("seq"))
    return status.group_members(log)


def l7_gossip_targets(spark: SparkSession, sf: str) -> DataFrame:
    nodes = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("nid"))
    return status.gossip_targets(nodes).groupBy("from_nid").agg(F.count(F.lit(1)).alias("n"))


def l5_status_sum(spark: SparkSession, sf: str) -> DataFrame:
    return status.group_metric(load(spark, sf, "events").withColumn("sid", F.col("user_id") % 12), "sid", "value")


def l8_gossip_dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    seen = events.unionByName(events.where("event_id % 4 = 0"))
    return status.delivered(seen, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def n2_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.engine_status(load(spark, sf, "postings"), load(spark, sf, "docs"), frontier.current(load(spark, sf, "frontier")))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "abcdefghijkln" and k[1:2].isdigit()}
