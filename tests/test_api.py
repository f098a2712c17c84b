import math
from datetime import datetime, timezone

import pytest

from termloom import api
from termloom.functions.serialization import UNDEFINED, deserialize, serialize
from termloom.operators import index

PAGES = "url string, final_url string, reason string, text string, links array<string>"


@pytest.mark.parametrize("x", [None, UNDEFINED, 0, -3, 2.5, 1e300, math.inf, "", 'quote"', True, False, [1, [None, "a"]], {"a": {"b": [True]}}, datetime(2024, 1, 2, 3, 4, 5, 6000, tzinfo=timezone.utc)])
def test_serialization_round_trip(x):
    assert deserialize(serialize(x)) == x


def test_serialization_edges():
    assert math.isnan(deserialize(serialize(math.nan)))
    assert str(deserialize(serialize(ValueError("bad")))) == "bad"
    for wrong in (b"x", {1, 2}):
        with pytest.raises(TypeError, match="Unsupported type"):
            serialize(wrong)
    loop: list = []
    loop.append(loop)
    with pytest.raises(ValueError, match="itself"):
        serialize(loop)
    with pytest.raises(ValueError, match="Unknown type"):
        deserialize('{"type": "symbol", "value": ""}')


def test_pipeline_and_service(spark, tmp_path):
    seeds = spark.createDataFrame([("t", 1, '<a href="/o/a">a</a><a href="/topics/x">x</a>')], "topic string, page int, html string")
    web = spark.createDataFrame([("https://h.example/o/a", "https://h.example/o/a", None, "caching databases", ["https://h.example/o/b"]), ("https://h.example/o/b", "https://h.example/o/b", None, "caching caching", [])], PAGES)
    report = api.run_pipeline(spark, str(tmp_path), seeds, web, base="https://h.example", batch=5, rounds=9, allowed=lambda u: u.startswith("https://h."))
    assert report["seed"] == {"added": 1, "skipped": 0, "discovered": 1, "frontierSize": 1} and report["crawl"]["crawled"] == 2 and report["index"]["docs"] == 2
    made = index.read(spark, f"{tmp_path}/index")
    engine = api.Engine(made, spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/frontier"))
    code, body = engine.handle("GET", "/search?q=caching")
    # every page holds the term, so its idf is 0 and the urls decide
    assert code == 200 and [r["url"] for r in body["results"]] == ["https://h.example/o/a", "https://h.example/o/b"] and body["totalMatches"] == 2
    assert engine.handle("GET", "/search?q=%20")[0] == 400 and engine.handle("POST", "/search?q=x")[0] == 404 and engine.handle("GET", "/nothing")[0] == 404 and engine.handle("GET", "/")[0] == 200
    code, body = engine.handle("GET", "/status")
    assert body["docs"]["count"] == 2 and body["frontier"]["seen"] == 2 and body["index"]["termCount"] == 2
    text = api.format_results(engine.search("caching databases"))
    assert text.startswith('2 matches for "caching databases" (cach, databas)') and "https://h.example/o/a" in text
    with pytest.raises(ValueError, match="Missing query"):
        engine.search("  ")
    code, body = engine.handle("GET", "/")
    assert body.startswith("<!DOCTYPE html>") and "search?q=" in body


def fake_web(url):
    """A few pages that link to one another; what fails does so in every way there is."""
    repo = lambda name, links: f'<title>{name}</title><div id="readme"><article class="markdown-body"><p>{name} keeps caching layers for distributed storage engines and their logs.</p></article></div>' + "".join(f'<a href="{x}">x</a>' for x in links)
    pages = {
        "https://github.com/topics/alpha?page=1": '<a href="/o/a">a</a><a href="/topics/x">x</a>', "https://github.com/topics/alpha?page=2": '<a href="/o/a">a</a>', "https://github.com/trending": '<a href="/o/b">b</a>',
        "https://github.com/o/a": repo("a", ["/o/c", "/o/moved", "/o/gone", "/o/image", "mailto:x@y"]), "https://github.com/o/b": repo("b", []), "https://github.com/o/c": repo("c", ["/o/a"]),
    }
    if url == "https://github.com/o/moved":
        return url, "https://github.com/login", 200, "text/html", 10, 1, "<p>sign in</p>", None
    if url == "https://github.com/o/image":
        return url, url, 200, "image/png", 10, 0, "", None
    return (url, url, 200, "text/html; charset=utf-8", len(pages[url]), 0, pages[url], None) if url in pages else (url, url, 404, "text/html", 0, 0, None, "HTTP 404")


def test_pipeline_that_fetches(spark, tmp_path):
    report = api.run_pipeline(spark, str(tmp_path), batch=10, rounds=5, fetcher=fake_web, topics=["alpha", "none"], languages=["x"], pause=0.0)
    assert report["seed"] == {"added": 2, "skipped": 0, "discovered": 2, "frontierSize": 2}
    assert (report["crawl"]["crawled"], report["crawl"]["errors"]) == (3, 3)
    states = {r.url.rsplit("/", 1)[1]: (r.status, r.error) for r in spark.read.parquet(f"{tmp_path}/frontier").collect()}
    assert states == {"a": ("seen", None), "b": ("seen", None), "c": ("seen", None), "moved": ("error", "disallowed-redirect"), "gone": ("error", "http-status"), "image": ("error", "content-type")}
    docs = {r.doc_key: r for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
    assert docs["https://github.com/o/a"].repoOwner == "o" and docs["https://github.com/o/a"].title == "a" and not docs["https://github.com/o/a"].lowContent
    assert api.Engine(index.read(spark, f"{tmp_path}/index")).search("caching storage").totalMatches == 3


def test_http_fetch_counts_redirects():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from termloom.sources.pages import http_fetch

    class Hops(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.strip("/"))
            self.send_response(302 if n else 200)
            self.send_header("Location" if n else "Content-Type", f"/{n - 1}" if n else "text/html")
            self.end_headers()
            if not n:
                self.wfile.write(b"<p>here</p>")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Hops)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [http_fetch(f"{base}/{n}")[1:3] + http_fetch(f"{base}/{n}")[5:7] for n in (0, 2, 5)] == [(f"{base}/0", 200, n, "<p>here</p>") for n in (0, 2, 5)]
        assert http_fetch(f"{base}/6")[5] == 6 and http_fetch(f"{base}/6")[2] == 302
    finally:
        server.shutdown()


def test_missing_dependency_is_not_hidden(monkeypatch):
    import __spark_entry__ as entry

    def broken(name):
        raise ModuleNotFoundError("no", name="numpy")

    if entry.importlib.util.find_spec("termloom.llm") is not None:
        monkeypatch.setattr(entry.importlib, "import_module", broken)
        with pytest.raises(ModuleNotFoundError):
            entry.queries()
