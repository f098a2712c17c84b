"""Crawling as dataflow: which fetches are let through, when, and what a batch changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.durable import durable
from termloom.functions.urls import url_host
from termloom.operators import frontier as fr

MAX_BYTES, MAX_REDIRECTS, INTERVAL_MS = 2 * 1024 * 1024, 5, 1000


def fetch_verdict(status: Column, content_type: Column, size: Column, redirects: Column) -> Column:
    """Why a fetched page is refused, null if it is accepted."""
    return (
        F.when(redirects > MAX_REDIRECTS, "too-many-redirects").when(status.isNull() | (status != 200), "http-status")
        .when(~F.coalesce(F.lower(content_type).rlike("text/html|application/xhtml"), F.lit(False)), "content-type").when(size > MAX_BYTES, "too-large")
    )


def schedule(requests: DataFrame, domain: str, arrival: str, interval: int = INTERVAL_MS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds start: each domain's fetches in the order of arrival, at least ``interval`` apart; those of one time by ``ties``.

    start_i = max over j <= i of (arrival_j - interval * j) + interval * i. Numbers and running maxima can be put
    together from parts, so requests are range-partitioned by domain and arrival, each sorted part is done by itself,
    and a domain that goes on in the next part hands over two numbers, however many requests it has. A null arrival
    counts as 0.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = requests.columns
    at = F.coalesce(F.col(arrival).cast("bigint"), F.lit(0))
    placed = requests.withColumn("_at", at).repartitionByRange(parts, domain, "_at", *ties, F.xxhash64(*names)).sortWithinPartitions(domain, "_at", *ties).withColumn("_part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, most = object(), 0, 0
        for batch in batches:
            numbers, tops = [], []
            for d, t in zip(batch.column(domain).to_pylist(), batch.column("_at").to_pylist()):
                number, most = (number + 1, max(most, t - interval * (number + 1))) if d == last else (0, t)
                last = d
                numbers.append(number)
                tops.append(most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(tops, pa.int64())], names=[*batch.schema.names, "_i", "_top"])

    done = durable(placed.mapInArrow(local, f"{kinds}, _i long, _top long"))
    sums = done.groupBy(F.col(domain).alias("_d"), "_part").agg(F.count(F.lit(1)).alias("n"), F.max("_top").alias("top"))
    order = Window.partitionBy("_d").orderBy("_part")
    before = sums.withColumn("skip", F.sum("n").over(order) - F.col("n")).withColumn("shifted", F.col("top") - F.col("skip") * interval)
    before = before.withColumn("earlier", F.max("shifted").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("skip > 0").select("_d", F.col("_part").alias("_p"), "skip", "earlier")
    # only the first domain of a part goes on from earlier ones: at most one row for each part
    rows = done.join(F.broadcast(before), F.col(domain).eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p")), "left")
    skip = F.coalesce("skip", F.lit(0))
    running = F.greatest(F.col("_top") - skip * interval, F.coalesce("earlier", F.lit(-(2**62))))
    return rows.select(*names, (running + (skip + F.col("_i")) * interval).alias("start"))


def rate_limit(requests: DataFrame, domain: str, arrival: str, interval: int = INTERVAL_MS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds wait: 0 if the request may go and stamps its domain, else the time left, without a stamp.

    Whether a request may go depends on the last one that did, so a domain's requests are read in order, as a stream
    that holds one stamp. Requests at one time are ordered by ``ties``.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        stamp = 0
        for batch in batches:
            waits = []
            for d, t in zip(batch.column(domain).to_pylist(), batch.column(arrival).to_pylist()):
                if d != last or t is None or t - stamp >= interval:
                    last, stamp, wait = d, t if t is not None else stamp, 0
                else:
                    wait = interval - (t - stamp)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(waits, pa.int64())], names=[*batch.schema.names, "wait"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.repartition(domain).sortWithinPartitions(domain, arrival, *ties).mapInArrow(fold, f"{kinds}, wait bigint")


def link_graph(docs: DataFrame) -> DataFrame:
    """(src, pos, dst) of every link."""
    return docs.select(F.col("doc_key").alias("src"), F.posexplode("links").alias("pos", "dst")).where(F.col("dst").isNotNull())


Pages = DataFrame | Callable[[DataFrame], DataFrame]


def crawl_batch(frontier: DataFrame, fetched: Pages, n: int, seed: str, now: int, allowed: Callable[[Column], Column] | None = None, link_filter: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: claims, takes the claimed URLs' pages from ``fetched``, and returns (new frontier, documents, summary).

    ``fetched`` is (url, final_url, reason, text, links, more fields): a row for each page that can be had, or what
    fetches them given the claimed (url), such as ``sources.pages.crawl_one``. A claimed URL without a row, with a
    reason, or led to a URL that is not allowed, becomes an error. Documents are keyed by the claimed URL.
    """
    claimed = durable(fr.claim(frontier, n, seed))
    pages = claimed.join(fetched(claimed) if callable(fetched) else fetched, "url", "left")
    fields = [c for c in pages.columns if c not in ("url", "final_url", "reason", "fetchedAt")]
    ok = allowed(F.col("final_url")) if allowed else F.lit(True)
    reason = F.when(F.col("final_url").isNull(), F.coalesce("reason", F.lit("not-found"))).when(F.col("reason").isNotNull(), F.col("reason")).when(~ok, "disallowed-redirect")
    judged = durable(pages.withColumn("why", reason))
    docs = judged.where("why IS NULL").select(F.col("url").alias("doc_key"), F.col("final_url").alias("url"), *fields, F.lit(now).cast("bigint").alias("fetchedAt"))
    links = docs.select(F.explode("links").alias("url"))
    links = links.where(link_filter(F.col("url"))) if link_filter else links
    after = fr.with_claimed(frontier, claimed, now)
    after = fr.mark_error(after, judged.where("why IS NOT NULL").select("url", F.col("why").alias("reason")), now)
    found = fr.add_batch(after, links)
    counts = judged.agg(F.count_if(F.col("why").isNull()).alias("crawled"), F.count_if(F.col("why").isNotNull()).alias("errors"))
    summary = counts.select("crawled", "errors", found.select("added").scalar().alias("linksFound"))
    return fr.with_added(after, links, now), docs, summary


def crawl_loop(frontier: DataFrame, fetched: Pages, batch: int, max_pages: int | None = None, rounds: int | None = None, stop_when: str = "idle", now: int = 0, on_batch: Callable[[dict], None] | None = None, **rules) -> tuple[DataFrame, list[DataFrame], dict[str, int]]:
    """Batches until ``max_pages``, ``rounds``, or a batch with nothing crawled (``stop_when="empty"``) and no errors either ("idle")."""
    total = {"crawled": 0, "errors": 0, "linksFound": 0, "rounds": 0}
    docs: list[DataFrame] = []
    while (max_pages is None or total["crawled"] < max_pages) and (rounds is None or total["rounds"] < rounds):
        size = batch if max_pages is None else min(batch, max_pages - total["crawled"])
        after, got, summary = crawl_batch(frontier, fetched, size, str(total["rounds"]), now + total["rounds"], **rules)
        row = summary.first().asDict()
        frontier = durable(after)
        docs.append(got)
        for k, v in row.items():
            total[k] += v
        total["rounds"] += 1
        if on_batch:
            on_batch(row)
        if stop_when != "never" and row["crawled"] == 0 and (stop_when == "empty" or row["errors"] == 0):
            break
    return frontier, docs, total


def with_domain(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("domain", url_host(F.col(url)))
