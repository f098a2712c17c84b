"""Fetching pages as a Spark data source, crawling single pages, and seeding a frontier from listing pages."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from urllib.error import HTTPError, URLError
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from termloom.durable import durable
from termloom.functions.html import parse_page, repo_links_of
from termloom.functions.urls import RESERVED_OWNERS, repo_url_allowed
from termloom.operators import frontier as fr
from termloom.operators.crawl import MAX_BYTES, MAX_REDIRECTS, fetch_verdict

SCHEMA = "url string, final_url string, status int, content_type string, size long, redirects int, html string, error string"
TIMEOUT_S = 15
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

# fixed values: the topics and languages whose listing pages seed a frontier by default
TOPICS = (
    "javascript python typescript rust go java cpp distributed-systems machine-learning deep-learning database web api cli devops kubernetes docker react nodejs algorithms "
    "data-structures operating-systems networking security cryptography compiler interpreter game-engine graphics ios android mobile frontend backend microservices "
    "serverless blockchain open-source framework library testing ci-cd monitoring search nlp computer-vision reinforcement-learning data-science visualization embedded"
).split()
LANGUAGES = "javascript python typescript java go rust c cpp csharp ruby php swift kotlin scala shell lua haskell elixir zig dart".split()


class _Redirects(HTTPRedirectHandler):
    """Follows up to MAX_REDIRECTS and counts them, the one too many included."""

    def __init__(self) -> None:
        self.seen = 0

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001
        self.seen += 1
        if self.seen > MAX_REDIRECTS:
            return None
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def http_fetch(url: str) -> tuple:
    """One GET: up to five redirects, fifteen seconds, a body of at most 2 MiB plus one byte, which marks it too large."""
    counter = _Redirects()
    try:
        with build_opener(counter).open(Request(url, headers={"User-Agent": "termloom"}), timeout=TIMEOUT_S) as r:
            body = r.read(MAX_BYTES + 1)
            return url, r.geturl(), r.status, r.headers.get("Content-Type"), len(body), counter.seen, body.decode("utf-8", "replace"), None
    except HTTPError as e:
        return url, e.geturl(), e.code, e.headers.get("Content-Type"), 0, counter.seen, None, str(e)
    except (URLError, OSError, ValueError) as e:
        return url, None, None, None, 0, counter.seen, None, str(e)


class _Some(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(0)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.parts = max(1, int(options.get("partitions", "8")))

    def partitions(self) -> list[InputPartition]:
        return [_Some(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return map(http_fetch, partition.urls)


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", json)``: one row a URL, errors included."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple] = http_fetch, partitions: int = 64, pause: float = 0.0) -> DataFrame:
    """SCHEMA rows for a (url) table of any size: fetched where the rows are, one host's URLs in one partition, ``pause`` seconds apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in batches:
            rows = []
            for u in frame["url"]:
                host = u.split("/")[2] if u.count("/") > 1 else u
                wait = last.get(host, float("-inf")) + pause - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                rows.append(fetcher(u))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return urls.select("url").repartition(partitions, F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).mapInPandas(run, SCHEMA)


def judged_pages(fetched: DataFrame, allowed: Callable[[Column], Column] | None = repo_url_allowed) -> DataFrame:
    """(url, final_url, reason, fields of the page) of SCHEMA rows: what a crawl takes from a fetch.

    reason is null for pages that are accepted: fetched without error, let through by ``fetch_verdict``, and at a final
    URL that is ``allowed``. Only these are parsed.
    """
    verdict = F.coalesce(fetch_verdict(F.col("status"), F.col("content_type"), F.col("size"), F.col("redirects")), F.when(F.col("html").isNull(), "no-body"))
    reason = F.when(F.col("status").isNull() & F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(verdict)
    final = F.coalesce("final_url", "url")
    if allowed is not None:
        reason = F.coalesce(reason, F.when(~F.coalesce(allowed(final), F.lit(False)), "disallowed-redirect"))
    rows = fetched.select("url", final.alias("final_url"), reason.alias("reason"), F.when(reason.isNull(), F.col("html")).alias("html"))
    parsed = rows.withColumn("page", parse_page(F.col("html"), F.col("final_url")))
    return parsed.select("url", "final_url", "reason", "page.*")


def crawl_one(urls: DataFrame, fetcher: Callable[[str], tuple] = http_fetch, allowed: Callable[[Column], Column] | None = repo_url_allowed, partitions: int = 64, pause: float = 1.0) -> DataFrame:
    """Fetch, judge and parse each of the ``urls``, one row each; a host's pages ``pause`` seconds apart."""
    return judged_pages(durable(fetch(urls, fetcher, partitions, pause)), allowed)


def listing_urls(topics: Iterable[str], base: str, max_pages: int = 10) -> list[tuple[str, int, str]]:
    """(topic, page, URL) of every listing page of the topics."""
    return [(t, p, f"{base}/topics/{t}?page={p}") for t in topics for p in range(1, max_pages + 1)]


def fetch_topics(spark: SparkSession, topics: Iterable[str], base: str, fetcher: Callable[[str], tuple] = http_fetch, max_pages: int = 10, pause: float = 0.5) -> DataFrame:
    """(topic, page, html): each topic's listing pages in their order until one is missing or adds nothing new. A topic is one task's work."""
    rows = spark.createDataFrame([(t,) for t in topics], "topic string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for topic in frame["topic"]:
                seen: set[str] = set()
                for _, page, url in listing_urls([topic], base, max_pages):
                    if page > 1:
                        time.sleep(pause)
                    _, _, status, _, _, _, html, _ = fetcher(url)
                    if status != 200 or html is None:
                        break
                    out.append((topic, page, html))
                    new = {p for p in re.findall(r'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"', html) if p.split("/")[0].lower() not in RESERVED_OWNERS} - seen
                    if not new:
                        break
                    seen |= new
            yield pd.DataFrame(out, columns=["topic", "page", "html"])

    return durable(rows.repartition(64, "topic").mapInPandas(run, "topic string, page int, html string"))


def trending_urls(base: str, languages: Iterable[str] = LANGUAGES) -> list[str]:
    return [f"{base}/trending"] + [f"{base}/trending/{x}" for x in languages]


def trending_repos(fetched: DataFrame, base: str) -> DataFrame:
    """(url): distinct repository URLs on fetched trending pages; pages that failed add none."""
    return fetched.where("status = 200").select(F.explode(repo_links_of(F.col("html"), base)).alias("url")).distinct()


def topic_pages(pages: DataFrame, base: str, max_pages: int = 10) -> DataFrame:
    """(topic, page, url): what listing pages add to their topic, in page order up to ``max_pages``, until a page adds nothing new.

    A page is missing or adds nothing at its topic's cut; later pages don't count.
    """
    links = pages.where(F.col("page") <= max_pages).select("topic", "page", F.explode_outer(repo_links_of(F.col("html"), base)).alias("url"))
    first = links.where("url IS NOT NULL").groupBy("topic", "url").agg(F.min("page").alias("page"))
    fresh = first.groupBy("topic", "page").agg(F.count(F.lit(1)).alias("n"))
    all_pages = pages.where(F.col("page") <= max_pages).select("topic", "page").distinct().join(fresh, ["topic", "page"], "left")
    order = Window.partitionBy("topic").orderBy("page")
    # pages from 1 on without a gap, each with something new
    good = all_pages.withColumn("i", F.row_number().over(order)).withColumn("ok", F.coalesce((F.col("n") > 0) & (F.col("page") == F.col("i")), F.lit(False)))
    good = good.withColumn("upto", F.min(F.col("ok").cast("int")).over(order)).where("upto = 1").select("topic", "page")
    return first.join(good, ["topic", "page"], "left_semi").select("topic", "page", "url")


def seed_urls(pages: DataFrame, base: str, max_pages: int = 10) -> DataFrame:
    """Distinct repository URLs of all topics."""
    return topic_pages(pages, base, max_pages).select("url").distinct()


def seed_frontier(known: DataFrame, topics: DataFrame, trending: DataFrame | None, base: str, now: int, max_pages: int = 10) -> tuple[DataFrame, DataFrame]:
    """The frontier with the repositories of the topics' listing pages (topic, page, html) and of fetched trending pages, and one row of counts.

    The counts are discovered, added, skipped and frontierSize.
    """
    urls = seed_urls(topics, base, max_pages)
    if trending is not None:
        urls = urls.unionByName(trending_repos(trending, base)).distinct()
    after = fr.with_added(known, urls, now)
    counts = fr.add_batch(known, urls).withColumn("discovered", F.col("added") + F.col("skipped"))
    return after, counts.withColumn("frontierSize", after.agg(F.count(F.lit(1)).alias("n")).scalar())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
