"""Search and status as a service, a command line, and the pipeline from seed to index."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from dataclasses import asdict
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.durable import durable
from termloom.functions.urls import repo_url_allowed
from termloom.operators import crawl, frontier, index, search, status
from termloom.sources import pages as page_source

TOP_N = 20


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>termloom</title></head><body>
<h1>termloom</h1>
<form id="f"><input id="q" name="q" autofocus placeholder="words"><button>Search</button></form>
<p id="status"></p><ol id="results"></ol>
<script>
const at = id => document.getElementById(id);
const line = (parent, tag, text) => parent.appendChild(Object.assign(document.createElement(tag), {textContent: text}));
const show = async () => {
  const s = await (await fetch("status")).json();
  at("status").textContent = Object.entries(s).filter(e => typeof e[1] == "object").map(e => e[0] + ": " + JSON.stringify(e[1])).join("; ");
};
at("f").onsubmit = async e => {
  e.preventDefault();
  const r = await (await fetch("search?q=" + encodeURIComponent(at("q").value))).json();
  at("results").replaceChildren();
  if (r.error) return line(at("results"), "p", r.error);
  line(at("results"), "p", r.totalMatches + " matches");
  for (const x of r.results) {
    const item = line(at("results"), "li", "");
    const link = line(item, "a", x.url);
    if (/^https?:/.test(x.url)) link.href = x.url;
    line(item, "div", x.score + " (" + Object.entries(x.breakdown).map(p => p.join(" ")).join(", ") + "); " + x.matchedTerms.join(", "));
  }
};
show();
</script></body></html>
"""


class Engine:
    """An index with what belongs to it. The index table should be written by ``index.write`` or cached."""

    def __init__(self, postings: DataFrame, docs: DataFrame | None = None, known: DataFrame | None = None, pagerank: DataFrame | None = None, total_docs: int | None = None) -> None:
        self.postings, self.docs, self.known, self.pagerank = postings, docs, known, pagerank
        self.total_docs = total_docs or (docs.select("doc_key") if docs is not None else postings.select("url")).distinct().count()

    def search(self, query: str, top_n: int = TOP_N, as_of: datetime | None = None) -> search.Response:
        if not query or not query.strip():
            raise ValueError("Missing query")
        return search.search(query, self.postings, top_n, self.total_docs, self.pagerank, as_of)

    def status(self) -> dict[str, Any]:
        """Counts of the parts there are."""
        out: dict[str, Any] = {"timestamp": datetime.now(timezone.utc).isoformat(), "index": {"termCount": index.index_stats(self.postings).first()[0]}}
        if self.docs is not None:
            out["docs"] = {"count": self.docs.select("doc_key").distinct().count()}
        if self.known is not None:
            out["frontier"] = frontier.stats(self.known).first().asDict()
        return out

    def handle(self, method: str, target: str) -> tuple[int, dict[str, Any] | str]:
        """(status, body) of a request; the front page's body is HTML, all others' JSON."""
        parts = urlsplit(target)
        if method != "GET" or parts.path not in ("/", "/search", "/status"):
            return 404, {"error": "Not found"}
        try:
            if parts.path == "/search":
                query = (parse_qs(parts.query).get("q") or [""])[0]
                return (200, asdict(self.search(query))) if query.strip() else (400, {"error": "Missing query parameter q"})
            return 200, self.status() if parts.path == "/status" else PAGE
        except Exception as e:  # noqa: BLE001 - a request's failure is its answer
            return 500, {"error": str(e)}

    def serve(self, port: int = 8080) -> ThreadingHTTPServer:
        """A small server for trying things out."""
        engine = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                code, body = engine.handle("GET", self.path)
                page = isinstance(body, str)
                data = body.encode() if page else json.dumps(body, default=str).encode()
                self.send_response(code)
                self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args: Any) -> None:
                pass

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def format_results(response: search.Response) -> str:
    """A response as lines of text."""
    lines = [f'{response.totalMatches} matches for "{response.query}" ({", ".join(response.terms) or "no terms"})']
    for i, r in enumerate(response.results, 1):
        b = r["breakdown"]
        lines.append(f"{i:3}. {r['score']:.4f}  {r['url']}")
        lines.append(f"     tfidf {b['tfidf']:.4f}, links {b['pagerank_global']:.4f} / {b['pagerank_repoOwner']:.4f}, recency {b['recency']:.4f}; {', '.join(r['matchedTerms'])}")
    return "\n".join(lines)


def run_pipeline(
    spark: SparkSession, out: str, seeds: DataFrame | None = None, fetched: DataFrame | None = None, known: DataFrame | None = None, base: str = "https://github.com", batch: int = 1000, rounds: int = 100,
    skip: Iterable[str] = (), link_filter: Callable | None = None, fetcher: Callable[[str], tuple] | None = None, topics: Iterable[str] = page_source.TOPICS, languages: Iterable[str] = page_source.LANGUAGES,
    allowed: Callable[[Column], Column] | None = repo_url_allowed, pause: float = 1.0,
) -> dict[str, Any]:
    """seed, crawl, index: each a step that ``skip`` can name. Tables lie below ``out``; returns the steps' counts.

    Listing pages come from ``seeds`` (topic, page, html), else the topics' and languages' pages are fetched. Pages come
    from ``fetched`` (url, final_url, reason, text, links), else each batch's are fetched, judged and parsed, a host's
    ``pause`` seconds apart. ``fetcher`` stands in for the network. A final URL must be ``allowed``.
    """
    skip, report = set(skip), {}
    fetcher = fetcher or page_source.http_fetch
    known = known if known is not None else spark.createDataFrame([], "url string, status string, addedAt bigint, claimedAt bigint, error string, errorAt bigint")
    if "seed" not in skip:
        trending = None
        if seeds is None:
            seeds = page_source.fetch_topics(spark, topics, base, fetcher, pause=pause)
            trending = durable(page_source.fetch(spark.createDataFrame([(u,) for u in page_source.trending_urls(base, languages)], "url string"), fetcher, 1, pause))
        after, counts = page_source.seed_frontier(known, seeds, trending, base, 0)
        report["seed"] = counts.first().asDict()
        known = durable(after)
    if "crawl" not in skip:
        pages = fetched if fetched is not None else lambda claimed: page_source.crawl_one(claimed, fetcher, allowed, pause=pause)
        known, got, report["crawl"] = crawl.crawl_loop(known, pages, batch, rounds=rounds, stop_when="empty", link_filter=link_filter, allowed=allowed)
        docs = got[0] if got else None
        for more in got[1:]:
            docs = docs.unionByName(more)
        known.write.mode("overwrite").parquet(f"{out}/frontier")
        if docs is not None:
            docs.write.mode("overwrite").parquet(f"{out}/docs")
    if "index" not in skip:
        docs = spark.read.parquet(f"{out}/docs")
        for name, kind in (("repoOwner", "string"), ("topics", "array<string>"), ("isFork", "boolean"), ("isArchived", "boolean"), ("lowContent", "boolean"), ("lastCommitDate", "string")):
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind))
        report["index"] = index.run_indexer(docs, f"{out}/index")
    return report


def load_config(path: str) -> dict[str, Any]:
    """A cluster's JSON settings: nodes, crawl batch and rounds."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(argv: list[str] | None = None) -> int:
    """``python -m termloom.api --index PATH [QUERY]``: one query, or one a line until exit."""
    from termloom.session import local_session

    parser = argparse.ArgumentParser(description="Search an index.")
    parser.add_argument("--index", required=True)
    parser.add_argument("--docs-total", type=int, default=0, help="0: as many as the index has")
    parser.add_argument("query", nargs="*")
    args = parser.parse_args(argv)
    engine = Engine(index.read(local_session(), args.index), total_docs=args.docs_total)
    for line in [" ".join(args.query)] if args.query else map(str.strip, sys.stdin):
        if line in ("exit", "quit", ":q"):
            break
        if line:
            print(format_results(engine.search(line)))
    return 0


__all__ = ["Engine", "format_results", "load_config", "main", "run_pipeline", "status"]

if __name__ == "__main__":
    sys.exit(main())
