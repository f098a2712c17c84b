"""URL normalisation, policies and parts as column expressions.

URLs of plain characters are handled by JVM expressions; the others (escapes, dot segments, spaces,
user names, non-ASCII) go through one Arrow UDF, which gets null for the plain ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import parse_qsl, quote, quote_plus, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: path prefixes, host labels and path patterns of the policies
ALLOWED_PREFIXES = ("/blog", "/engineering", "/developers", "/posts", "/articles", "/insights", "/news", "/releases", "/changelog", "/techblog", "/tech")
SKIPPED_LABELS = ("www", "blog", "blogs", "engineering", "eng", "tech", "developer", "developers", "dev")
TOP_LABELS = ("com", "org", "net", "io", "co", "dev", "ai", "us", "uk")
_NAME = "[a-zA-Z0-9_.-]+"
REPO_HOST = "github.com"
REPO_ALLOWED = f"^/{_NAME}/{_NAME}(?:/?$|/wiki|/releases|/blob/[^/]+/README)"
REPO_BLOCKED = f"^/(?:login|signup|settings|marketplace|sponsors|apps|orgs|explore|notifications|pulls|issues|-/|{_NAME}/{_NAME}/(?:commit|pull|issues|actions|projects))"
RESERVED_OWNERS = (
    "topics trending explore settings login signup marketplace sponsors apps orgs notifications pulls issues features pricing security enterprise "
    "customer-stories readme about collections events team contact"
).split()

_PLAIN = r"^(?i:https?)://[A-Za-z0-9][A-Za-z0-9.-]*(:[0-9]{1,4})?(/[A-Za-z0-9_~!$&'()*+,;=:@./-]*)?(\?[A-Za-z0-9_=&*.-]*)?(#[!-~]*)?$"
_PARTS = re.compile(r"^(https?):[/\\]*(?:([^/\\?#]*)@)?([^/\\?#:@\[\]]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?$", re.I | re.S)
_PATH_SAFE = "/!$&'()*+,;=:@%~|[]^-._"


def _host(host: str) -> str | None:
    try:
        plain = host.lower() if host.isascii() else host.encode("idna").decode().lower()
    except UnicodeError:
        return None
    return None if re.search(r"[\s<>^|%#]", plain) or plain.startswith(".") and plain.strip(".") == "" else plain


def _path(path: str) -> str:
    """Backslashes as slashes, dot segments resolved, other characters percent-encoded as UTF-8."""
    out: list[str] = []
    steps = path.replace("\\", "/").split("/")[1:]
    for i, s in enumerate(steps):
        dots = re.sub("%2e", ".", s, flags=re.I)
        last = i == len(steps) - 1
        if dots == "..":
            out = out[:-1]
        if dots in (".", ".."):
            out += [""] if last else []
        else:
            out.append(s)
    return "/" + quote("/".join(out), safe=_PATH_SAFE)


def split_url(raw: str | None) -> tuple[str, str, str, str, str] | None:
    """(scheme, host, port, path, query) of an absolute http or https URL, else None."""
    if raw is None:
        return None
    m = _PARTS.match(re.sub(r"[\t\r\n]", "", raw.strip(" \t\r\n\f\x00")))
    host = m and _host(m[3])
    if not m or not host or (m[4] and int(m[4]) > 65535):
        return None
    scheme, port = m[1].lower(), str(int(m[4])) if m[4] else ""
    if (scheme, port) in (("http", "80"), ("https", "443")):
        port = ""
    return scheme, host, port, _path(m[5] or "/"), (m[6] or "")[1:]


def normalize(raw: str | None) -> str | None:
    parts = split_url(raw)
    if parts is None:
        return None
    scheme, host, port, path, query = parts
    port = "" if port in ("80", "443") else port
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    pairs = sorted(parse_qsl(query, keep_blank_values=True), key=lambda kv: kv[0])
    form = "&".join(quote_plus(k, safe="*-._").replace("~", "%7E") + "=" + quote_plus(v, safe="*-._").replace("~", "%7E") for k, v in pairs)
    return f"{scheme}://{host}{':' + port if port else ''}{path}{'?' + form if form else ''}"


@F.pandas_udf(StringType())
def _normalize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: normalize(u) if isinstance(u, str) else None).astype(object)


@F.pandas_udf(StringType())
def _resolve_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if isinstance(b, str) and isinstance(h, str) else None for b, h in zip(base, href)], dtype=object)


def _form(query: Column) -> Column:
    """A query's pairs by name (stable); an empty pair goes, a bare name gets its '='."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    made = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    return F.array_join(F.transform(F.array_sort(made), lambda s: s["p"]), "&")


def normalize_url(url: Column) -> Column:
    """The canonical form, null for anything but absolute http and https URLs.

    The host is lower-cased, ports 80 and 443 go whatever the scheme, one trailing slash, the fragment and the user
    part go, query parameters are sorted by name and written as a form; the root path is '/'.
    """
    plain = url.rlike(_PLAIN) & ~url.rlike(r"/\.|\.\.")
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z]+):", 1)), F.lower(F.regexp_extract(url, "^[^/]+//([^/:?#]+)", 1))
    port = F.regexp_replace(F.regexp_extract(url, "^[^/]+//[^/:?#]+:([0-9]+)", 1), "^0+(?=[0-9])", "")
    path = F.regexp_extract(url, "^[^/]+//[^/?#]*(/[^?#]*)", 1)
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
    form = _form(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    native = F.concat(scheme, F.lit("://"), host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(form == "", "").otherwise(F.concat(F.lit("?"), form)))
    return F.when(plain, native).otherwise(_normalize_udf(F.when(F.coalesce(plain, F.lit(False)), F.lit(None)).otherwise(url)))


def url_host(url: Column) -> Column:
    """Lower-cased host, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\s]+)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """The path, '/' if it is empty; null without a host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(url_host(url).isNotNull(), F.when(path == "", "/").otherwise(path))


def company_tag(url: Column) -> Column:
    """The first telling label of the host, else its first; 'unknown' without a host."""
    labels = F.split(url_host(url), r"\.")
    telling = F.filter(labels, lambda x: ~x.isin(*SKIPPED_LABELS, *TOP_LABELS))
    return F.coalesce(F.try_element_at(telling, F.lit(1)), F.try_element_at(labels, F.lit(1)), F.lit("unknown"))


def has_allowed_path(url: Column) -> Column:
    """Whether the lower-cased path is the root or begins with a listed prefix, whole segment or not."""
    return F.coalesce(F.lower(url_path(url)).rlike("^/$|^(?:" + "|".join(ALLOWED_PREFIXES) + ")"), F.lit(False))


def is_domain_allowed(url: Column, domains: Iterable[str]) -> Column:
    """Whether the host, or a parent of it with at least two labels, is listed."""
    names = sorted(domains)
    tails = ["(?:^|\\.)" + re.escape(d) for d in names if "." in d] + ["^" + re.escape(d) for d in names if "." not in d]
    return F.coalesce(url_host(url).rlike("(?:" + "|".join(tails or ["(?!)"]) + ")$"), F.lit(False))


class Policy:
    """Domains whose pages may be visited; a list is lower-cased, a set is taken as it is."""

    def __init__(self, domains: Iterable[str]) -> None:
        self.domains = set(domains) if isinstance(domains, (set, frozenset)) else {d.lower() for d in domains}

    def is_domain_allowed(self, url: Column) -> Column:
        return is_domain_allowed(url, sorted(self.domains))

    def is_allowed(self, url: Column) -> Column:
        normal = normalize_url(url)
        return normal.isNotNull() & self.is_domain_allowed(normal) & has_allowed_path(normal)


def repo_url_allowed(url: Column, host: str = REPO_HOST) -> Column:
    """Whether a URL is a repository's page, wiki, releases or README on exactly ``host``; blocked paths win, case counts."""
    path = url_path(url)
    return F.coalesce((url_host(url) == host) & ~path.rlike(REPO_BLOCKED) & path.rlike(REPO_ALLOWED), F.lit(False))


def resolve_link(base: Column, href: Column) -> Column:
    """An href against its page's URL."""
    absolute = href.rlike("^https?://")
    rooted = href.rlike("^/(?!/)") & base.rlike("^https?://[^/?#]+")
    native = F.when(absolute, href).when(rooted, F.concat(F.regexp_extract(base, "^(https?://[^/?#]+)", 1), href))
    return F.coalesce(native, _resolve_udf(F.when(native.isNull(), base), F.when(native.isNull(), href)))


def path_segment(url: Column, at: int) -> Column:
    """The part of the URL between slashes number ``at`` (from 0), '' if there is none."""
    return F.coalesce(F.try_element_at(F.split(url, "/"), F.lit(at + 1)), F.lit(""))
