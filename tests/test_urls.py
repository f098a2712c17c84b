import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import html, urls

NORMAL = {
    "https://blog.example.com/post/1": "https://blog.example.com/post/1", "https://blog.example.com/post/1/": "https://blog.example.com/post/1",
    "https://BLOG.EXAMPLE.COM/Post": "https://blog.example.com/Post", "https://blog.example.com/post#section": "https://blog.example.com/post",
    "https://blog.example.com:443/post": "https://blog.example.com/post", "http://blog.example.com:80/post": "http://blog.example.com/post", "http://h.example:443/": "http://h.example/",
    "https://blog.example.com:8080/post": "https://blog.example.com:8080/post", "ftp://files.example.com/doc": None, "not a url": None, "": None,
    "https://example.com": "https://example.com/", "https://example.com/": "https://example.com/", "https://example.com/search?b=2&a=1": "https://example.com/search?a=1&b=2",
    "https://u:p@h.example/x": "https://h.example/x", "https://h.example/x?a": "https://h.example/x?a=", "https://h.example/x?a=b%20c": "https://h.example/x?a=b+c",
    "https://h.example/a/../b/./c": "https://h.example/b/c", "https://h.example/für": "https://h.example/f%C3%BCr", "mailto:a@b.example": None,
    "HTTPS://h.example/a?z=1&a=2&z=0": "https://h.example/a?a=2&z=1&z=0",
}


def test_normalize(spark):
    rows = spark.createDataFrame([(u,) for u in [*NORMAL, None]], "u string").select("u", urls.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == NORMAL | {None: None}


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(max_size=30), st.text(alphabet="ab/.?&=#%2e é", max_size=20))
def test_normalize_twice_is_once(junk, path):
    for raw in (junk, "https://h.example/" + path):
        once = urls.normalize(raw)
        if once is not None:  # each pass drops one trailing slash of the path
            bare = [re.sub(r"/+(?=\?|$)", "", u or "") for u in (once, urls.normalize(once))]
            assert bare[0] == bare[1]


def test_native_and_general_forms_agree(spark):
    raw = [f"{s}://H{i}.example{p}{q}" for i, (s, p, q) in enumerate((s, p, q) for s in ("http", "https", "HTTP") for p in ("", "/", "/a", "/a/", "/a/b.c/", ":443/x", ":8080") for q in ("", "?b=1&a=2", "?x", "#f", "?a=1#f"))]
    rows = spark.createDataFrame([(u,) for u in raw], "u string").select("u", urls.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == {u: urls.normalize(u) for u in raw}


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (urls.company_tag, {"https://engineering.fb.com/x": "fb", "https://www.uber.com/blog": "uber", "https://netflixtechblog.com/p": "netflixtechblog", "junk": "unknown"}),
        (urls.has_allowed_path, {"https://e.com/": True, "https://e.com": True, "https://e.com/blog/p": True, "https://e.com/technology": True, "https://e.com/careers": False, "junk": False}),
        (urls.Policy(["example.com", "blog.stripe.com"]).is_allowed, {"https://example.com/blog/p": True, "https://example.com/careers": False, "https://evil.com/blog": False, "https://www.example.com/": True, "https://notexample.com/blog": False, "https://blog.stripe.com/posts/1": True}),
        (urls.repo_url_allowed, {"https://github.com/o/r": True, "https://github.com/o/r/pulls": False, "https://github.com/loginx/y": False, "https://www.github.com/o/r": False, "https://github.com/o/r/wiki/x": True, "https://github.com/o/r/blob/main/README.md": True, "https://github.com/o": False}),
    ],
)
def test_policies(spark, f, cases):
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", f(F.col("u")).alias("x")).collect()
    assert {r.u: r.x for r in rows} == cases


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_page_fields():
    long = "word " * 20
    body = f'<p class="f4 my-3"> A tool </p><a class="topic-tag">db</a><a class="topic-tag"> </a><span id="repo-stars-counter">1,2k</span><relative-time datetime="2024-01-02T00:00:00Z"></relative-time><span class="text-small">Forked from a/b</span><div class="archived-notice">Archived.</div><div id="readme"><h1>Title</h1><p>{long}<script>x()</script></p><ul><li>one</li></ul></div><a href="/x/">x</a><a href="#f">f</a><a href="mailto:a@b">m</a><a href="/x">again</a>'
    f = html.page_fields(page(body, '<meta property="og:title" content=" T "><title>no</title>'), "https://h.example/own/name")
    assert (f["title"], f["repoOwner"], f["repoName"], f["description"], f["topics"], f["stars"]) == ("T", "own", "name", "A tool", ["db"], "1,2k")
    assert f["isFork"] and f["isArchived"] and not f["lowContent"] and f["lastCommitDate"].startswith("2024-01-02")
    assert f["links"] == ["https://h.example/x"] and f["text"].startswith("A tool\n\nTitle") and "x()" not in f["text"] and "* one" in f["text"]


def test_page_fallbacks():
    f = html.page_fields(page('<article class="markdown-body">short</article><time datetime="2024-03-15"></time>', '<meta property="og:description" content="Nice. 12,345 stars"><title>t</title>'), "https://h.example/o/r")
    assert f["text"] == "Nice. 12,345 stars\n\nshort" and f["lowContent"] and f["stars"] == "12,345" and f["published"] == "2024-03-15T00:00:00.000Z" and f["title"] == "t"
    empty = html.page_fields(None, None)
    assert empty["text"] == "" and empty["links"] == [] and empty["published"] is None and empty["lowContent"]


def test_parse_page_column(spark):
    row = spark.createDataFrame([(page("<a href='/a'>a</a>"), "https://h.example/")], "h string, u string").select(html.parse_page(F.col("h"), F.col("u")).alias("p")).first()
    assert row.p.links == ["https://h.example/a"]
