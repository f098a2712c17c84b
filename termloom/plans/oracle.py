"""The same queries in SQL. Fixed values (suffixes, stop words, prefixes, owners) are those of the functions; tests hold them against known cases."""

from __future__ import annotations

from termloom.functions.text import STEP_2, STEP_3, STEP_4, stop_words
from termloom.functions.urls import ALLOWED_PREFIXES, REPO_ALLOWED, REPO_BLOCKED, RESERVED_OWNERS, SKIPPED_LABELS, TOP_LABELS
from termloom.plans.reference import AS_OF, BASE, HREFS, NODES, NOW, SUFFIXES


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


M0, M1, M2 = "^[^aeiou]*[aeiou]+[^aeiou]", "^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]*$", "^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]+[^aeiou]"
VOWEL, CVC = "^[^aeiou]*[aeiou]", "^[^aeiou]+[aeiou][^aeiouwxy]$"


def _step(prev: str, name: str, pattern: str, expression: str) -> str:
    """A stemming step: s and f are the pattern's groups in the word w."""
    return f"""{name} AS (SELECT token, CASE WHEN length(token) < 3 THEN w ELSE {expression} END AS w
  FROM (SELECT token, w, regexp_extract(w, '{pattern}', 1) AS s, regexp_extract(w, '{pattern}', 2) AS f FROM {prev}))"""


def _replace(table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE WHEN f <> '' AND regexp_matches(s, '{M0}') THEN s || CASE f {cases} END ELSE w END"


def stems(source: str) -> str:
    """CTEs that end in stems(token, term) over the tokens of ``source``."""
    after = f"""CASE WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e'
    WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND NOT regexp_matches(s, '[aeiouylsz]$') THEN left(s, -1)
    WHEN regexp_matches(s, '{CVC}') THEN s || 'e' ELSE s END"""
    return ",\n".join(
        [
            f"w0 AS (SELECT DISTINCT token, token AS w FROM {source})",
            _step("w0", "w1", "^(.+?)(ss|i)es$", "CASE WHEN f <> '' THEN s || f WHEN regexp_matches(w, '^.+[^s]s$') THEN left(w, -1) ELSE w END"),
            _step("w1", "w2", "^(.+?)(ed|ing)$", f"CASE WHEN regexp_matches(w, '^.+eed$') THEN CASE WHEN regexp_matches(left(w, -3), '{M0}') THEN left(w, -1) ELSE w END WHEN f <> '' AND regexp_matches(s, '{VOWEL}') THEN {after} ELSE w END"),
            _step("w2", "w3", "^(.+)(y)$", f"CASE WHEN f <> '' AND regexp_matches(s, '{VOWEL}') THEN s || 'i' ELSE w END"),
            _step("w3", "w4", f"^(.+?)({'|'.join(STEP_2)})$", _replace(STEP_2)),
            _step("w4", "w5", f"^(.+?)({'|'.join(STEP_3)})$", _replace(STEP_3)),
            _step("w5", "w6", f"^(.+?)({'|'.join(STEP_4)})$", f"CASE WHEN f <> '' THEN CASE WHEN regexp_matches(s, '{M2}') THEN s ELSE w END WHEN regexp_matches(w, '^.+(s|t)ion$') AND regexp_matches(left(w, -3), '{M2}') THEN left(w, -3) ELSE w END"),
            _step("w6", "w7", "^(.+)(e)$", f"CASE WHEN f <> '' AND (regexp_matches(s, '{M2}') OR (regexp_matches(s, '{M1}') AND NOT regexp_matches(s, '{CVC}'))) THEN s ELSE w END"),
            _step("w7", "w8", "^(.*)(ll)$", f"CASE WHEN f <> '' AND regexp_matches(w, '{M2}') THEN left(w, -1) ELSE w END"),
            "stems AS (SELECT token, w AS term FROM w8)",
        ]
    )


_META = "repoOwner, topics, isFork, isArchived, lowContent, lastCommitDate"
_DEFAULTS = """coalesce(repoOwner, '') AS repoOwner, coalesce(topics, []) AS topics, coalesce(isFork, false) AS isFork,
  coalesce(isArchived, false) AS isArchived, coalesce(lowContent, false) AS lowContent, coalesce(lastCommitDate, '') AS lastCommitDate"""
_META_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in _META.split(", "))
PAGES = f"""WITH pages AS (SELECT doc_key, text, {_DEFAULTS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_key
  ORDER BY fetchedAt DESC NULLS LAST, text DESC NULLS LAST, {_META_ORDER}) AS r FROM docs WHERE doc_key IS NOT NULL) WHERE r = 1)"""
RAW = ", raw AS (SELECT doc_key, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM pages)"
KEPT = RAW + f", tok AS (SELECT doc_key, token FROM raw WHERE token NOT IN ({_list(stop_words())}))"
COUNTS = PAGES + KEPT + ", " + stems("tok") + ", counts AS (SELECT doc_key, term, count(*) AS tf FROM tok JOIN stems USING (token) WHERE term <> '' GROUP BY ALL)"

STATE = f"""WITH given AS (SELECT term, url, CAST(coalesce(nullif(tf, 0), 1) AS BIGINT) AS tf, indexedAt, {_DEFAULTS} FROM postings WHERE term <> '' AND url IS NOT NULL),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, url ORDER BY indexedAt DESC NULLS LAST, tf DESC, {_META_ORDER}) AS r FROM given) WHERE r = 1)"""


def _query_terms(queries: str) -> str:
    """CTEs that end in qt(query_id, pos, term)."""
    return f"""q AS ({queries}),
ql AS (SELECT query_id, regexp_extract_all(lower(query), '[a-z]+') AS l FROM q),
qtok AS (SELECT query_id, i, l[i] AS token FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ql) WHERE l[i] NOT IN ({_list(stop_words())})),
{stems("qtok")},
qt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS pos FROM qtok JOIN stems USING (token) WHERE term <> '' GROUP BY query_id, term)"""


_HITS = "SELECT query_id, max(query) AS query FROM hits WHERE query_id IS NOT NULL GROUP BY query_id"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _recency(date: str) -> str:
    at = f"CASE WHEN regexp_matches({date}, '{_ISO}') THEN try_cast(replace(replace({date}, 'T', ' '), 'Z', '') AS TIMESTAMP) END"
    return f"(CASE WHEN {at} IS NULL THEN 0.3 ELSE greatest(0.0, 1.0 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({at})) / 1000.0 / 94608000000.0) END)::DOUBLE"


def _round4(x: str) -> str:
    return f"floor(({x})::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000.0::DOUBLE"


def _found(queries: str) -> str:
    return STATE + ",\n" + _query_terms(queries) + """,
df AS (SELECT term, count(*) AS df FROM state GROUP BY term),
m AS (SELECT query_id, pos, term, url, tf, ln(((SELECT count(DISTINCT doc_key) FROM docs)::DOUBLE + 1) / (df + 1)) AS idf FROM qt JOIN state USING (term) JOIN df USING (term)),
found AS (SELECT query_id, url, sum(tf * idf ORDER BY pos) AS x, string_agg(term, ' ' ORDER BY pos) AS matched, min(pos) AS p0 FROM m GROUP BY query_id, url)"""


def _scored(queries: str) -> str:
    return _found(queries) + f""",
pr AS (SELECT url, g, o FROM (SELECT url, global AS g, repoOwner AS o, row_number() OVER (PARTITION BY url ORDER BY global DESC NULLS LAST, repoOwner DESC NULLS LAST) AS r FROM pagerank) WHERE r = 1),
best AS (SELECT query_id, greatest(max(x), 0.0) AS best, count(*) AS n FROM found GROUP BY query_id),
parts AS (SELECT f.query_id, f.url, f.matched, n AS totalMatches,
  x / (CASE WHEN best = 0 THEN 1.0 ELSE best END) * (CASE WHEN s.lowContent THEN 0.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN s.isFork THEN 0.7 ELSE 1.0 END)::DOUBLE AS t,
  coalesce(nullif(g, 0), 0.5) AS pg, coalesce(nullif(o, 0), 0.5) AS po, {_recency("s.lastCommitDate")} * (CASE WHEN s.isArchived THEN 0.8 ELSE 1.0 END)::DOUBLE AS r
  FROM found f JOIN best b ON b.query_id = f.query_id JOIN m ON m.query_id = f.query_id AND m.url = f.url AND m.pos = f.p0
  JOIN state s ON s.url = m.url AND s.term = m.term LEFT JOIN pr ON pr.url = f.url),
scored AS (SELECT *, {_round4("0.65::DOUBLE * t + 0.2::DOUBLE * pg + 0.1::DOUBLE * po + 0.05::DOUBLE * r")} AS score FROM parts)"""


def _search(queries: str) -> str:
    return _scored(queries) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, url, score, {_round4("t")} AS tfidf, {_round4("pg")} AS pagerank_global, {_round4("po")} AS pagerank_repoOwner, {_round4("r")} AS recency, matched, totalMatches
FROM ranked WHERE rank <= 20"""


URLS = "WITH u AS (SELECT DISTINCT url FROM frontier WHERE url IS NOT NULL)"
_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\s]+)', 1)), '')"
_PATH = r"(CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]+') THEN coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/') END)"
_MADE = f"WITH u AS (SELECT DISTINCT url FROM frontier WHERE url IS NOT NULL UNION ALL SELECT 'https://www.' || h || p FROM (SELECT DISTINCT {_HOST} AS h FROM docs WHERE url IS NOT NULL), (SELECT unnest(['', '/', '/blog/1', '/technology', '/News', '/careers']) AS p))"
_PREFIX = f"coalesce(regexp_matches(lower({_PATH}), '^/$|^({'|'.join(ALLOWED_PREFIXES)})'), false)"


def _domains(domains: list[str]) -> str:
    tests = " OR ".join(f"{_HOST} = '{d}' OR {_HOST} LIKE '%.{d}'" for d in domains)
    return f"coalesce({tests}, false)"


def normal(url: str) -> str:
    """The canonical form of URLs without escapes, user parts and dot segments."""
    path = f"regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1)"
    query = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    pairs = f"list_transform(list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    return f"""(CASE WHEN regexp_matches({url}, '^(?i:https?)://[^/?#]') THEN lower(regexp_extract({url}, '^([a-zA-Z]+:)', 1)) || '//'
  || regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#]*)', 1)), ':(80|443)$', '')
  || CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END
  || CASE WHEN {query} = '' THEN '' ELSE '?' || array_to_string({pairs}, '&') END END)"""


FRONTIER = """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY
  greatest(coalesce(addedAt, 0), coalesce(claimedAt, 0), coalesce(errorAt, 0)) DESC, status DESC NULLS LAST, addedAt DESC NULLS LAST, claimedAt DESC NULLS LAST, error DESC NULLS LAST, errorAt DESC NULLS LAST) AS r
  FROM frontier WHERE url IS NOT NULL),
known AS (SELECT url, status, addedAt, claimedAt, error, errorAt FROM ranked WHERE r = 1)"""
INCOMING = FRONTIER + f""",
incoming AS (SELECT unnest(links) AS raw FROM docs UNION ALL SELECT unnest(['not a url', 'mailto:a@b'])),
judged AS (SELECT coalesce(n, raw) AS url, n IS NOT NULL AND i = 1 AND k.url IS NULL AS added, CASE WHEN n IS NULL THEN 'invalid-url' WHEN i > 1 OR k.url IS NOT NULL THEN 'duplicate' END AS reason
  FROM (SELECT raw, n, row_number() OVER (PARTITION BY n ORDER BY raw) AS i FROM (SELECT raw, {normal("raw")} AS n FROM incoming WHERE raw IS NOT NULL)) x LEFT JOIN known k ON k.url = n)"""

LOG = """WITH log AS (SELECT 'g' AS gid, 'u' || user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'del' ELSE 'append' END AS op,
  CAST(event_id AS VARCHAR) AS value, event_id AS seq FROM events)"""
FOLD = LOG + """, base AS (SELECT gid, key, max(seq) AS since, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log WHERE op <> 'append' GROUP BY ALL),
live AS (SELECT l.gid, l.key, l.value, l.seq, true AS a FROM log l LEFT JOIN base b USING (gid, key) WHERE l.op = 'append' AND l.seq > coalesce(b.since, -1)
  UNION ALL SELECT gid, key, value, since, false FROM base WHERE op = 'put'),
fold AS (SELECT gid, key, string_agg(value, ',' ORDER BY seq) AS v, bool_or(a) AS is_list FROM live GROUP BY ALL)"""

_NODE_JSON = "'{\"ip\":\"' || ip || '\",\"port\":' || port || '}'"


def _nodes(n: int, name: str = "nodes") -> str:
    values = ", ".join(f"('{ip}', {port})" for ip, port in NODES[:n])
    return f"{name} AS (SELECT ip, port, sha256({_NODE_JSON}) AS nid FROM (VALUES {values}) t(ip, port))"


KEYS = """WITH keys AS (SELECT DISTINCT doc_key AS key, sha256('"' || doc_key || '"') AS kid FROM docs WHERE doc_key IS NOT NULL)"""
_RENDEZVOUS = """(SELECT key, arg_max(nid, sha256('"' || kid || nid || '"')) AS nid FROM keys, {} GROUP BY key)"""
_TOPIC_LINKS = f"""WITH found AS (SELECT topic, page, unnest(regexp_extract_all(html, 'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"', 1)) AS p FROM seed_pages WHERE page <= 10),
own AS (SELECT topic, page, '{BASE}/' || p AS url FROM found WHERE lower(split_part(p, '/', 1)) NOT IN ({_list(RESERVED_OWNERS)})),
first AS (SELECT topic, url, min(page) AS page FROM own GROUP BY ALL),
listed AS (SELECT DISTINCT topic, page FROM seed_pages WHERE page <= 10),
fresh AS (SELECT topic, page, row_number() OVER (PARTITION BY topic ORDER BY page) = page AND (SELECT count(*) FROM first f WHERE f.topic = l.topic AND f.page = l.page) > 0 AS ok FROM listed l),
good AS (SELECT topic, page FROM (SELECT *, bool_and(ok) OVER (PARTITION BY topic ORDER BY page) AS upto FROM fresh) WHERE upto),
seeds AS (SELECT topic, page, url FROM first JOIN good USING (topic, page))"""

_DATE_SQL = {"2024-03-15T10:00:00Z": "2024-03-15T10:00:00.000Z", "2024-03-15": "2024-03-15T00:00:00.000Z", "Fri, 15 Mar 2024 10:00:00 +0200": "2024-03-15T08:00:00.000Z", "March 15, 2024": "2024-03-15T00:00:00.000Z", "soon": None, "": None}


def _date(i: int) -> str:
    """The instant of the i-th date of a made page, null if it is none."""
    return f"[{', '.join(repr(d) if d else 'NULL' for d in _DATE_SQL.values())}][CAST(k // {3**i} % {len(_DATE_SQL)} AS INT) + 1]"


_N = "length(url)"
_WAITS = """WITH RECURSIVE a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events),
w AS (SELECT event_id, user_id, arrival, i, CAST(0 AS BIGINT) AS wait, arrival AS stamp FROM a WHERE i = 1
  UNION ALL SELECT a.event_id, a.user_id, a.arrival, a.i, CASE WHEN a.arrival - stamp >= 3600000 THEN 0 ELSE 3600000 - (a.arrival - stamp) END, CASE WHEN a.arrival - stamp >= 3600000 THEN a.arrival ELSE stamp END
  FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1)
SELECT event_id, user_id, arrival, wait FROM w"""


def _round(k: int, n: int) -> str:
    """CTEs of one crawl round: from frontier f{k} (url, status) to f{k + 1}."""
    return f""",
c{k} AS (SELECT url FROM f{k} WHERE status = 'unseen' ORDER BY sha256(url || '{k}'), url LIMIT {n}),
g{k} AS (SELECT c.url, links FROM c{k} c JOIN page USING (url)),
n{k} AS (SELECT DISTINCT {normal('l')} AS u FROM (SELECT unnest(links) AS l FROM g{k})),
f{k + 1} AS (SELECT f.url, CASE WHEN c.url IS NULL THEN f.status WHEN g.url IS NULL THEN 'error' ELSE 'seen' END AS status FROM f{k} f LEFT JOIN c{k} c ON c.url = f.url LEFT JOIN g{k} g ON g.url = f.url
  UNION ALL SELECT u, 'unseen' FROM n{k} WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM f{k}))"""


_STATS = "SELECT count(*) FILTER (status = 'unseen') AS unseen, count(*) FILTER (status = 'seen') AS seen, count(*) FILTER (status = 'error') AS error, count(*) AS total FROM "
_WEB = FRONTIER + """, page AS (SELECT doc_key AS url, max(links) AS links FROM docs WHERE doc_key IS NOT NULL GROUP BY doc_key)"""

_K = "WITH p AS (SELECT doc_id, doc_id % 20000 AS k FROM documents)"

ORACLES = {
    "a5_process_text": COUNTS + " SELECT doc_key, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_distinct, max(tf) AS most FROM counts GROUP BY doc_key",
    "b6_create_policy": _MADE + f" SELECT url, {_domains(['code.example', 'mill.example'])} AS listed, {_domains(['mill.example'])} AS as_is FROM u",
    "c1_text": _K + """ SELECT doc_id, array_to_string(list_filter([CASE WHEN k % 4 <> 3 THEN 'D' || k END, CASE k % 3 WHEN 0 THEN 'Read ' || k || chr(10) || chr(10) || '* one' WHEN 1 THEN 'A long text on page ' || k END],
  lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text FROM p""",
    "c5_metadata": _K + """ SELECT doc_id, 'o' || k AS "repoOwner", 'r' || k AS "repoName", CASE WHEN k % 4 < 2 THEN 'D' || k ELSE '' END AS description, CASE WHEN k % 2 = 0 THEN 'L' || k ELSE '' END AS language,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 't' || k ELSE 't' || k || ',t' || k END AS topics, CASE WHEN k % 5 = 0 THEN '' || k ELSE '' END AS stars, CASE WHEN k % 13 = 0 THEN '2024-01-01' ELSE '' END AS "lastCommitDate",
  k % 7 = 0 AS "isFork", k % 11 = 0 AS "isArchived", true AS "lowContent" FROM p""",
    "d9_store_get": "SELECT c_mktsegment AS gid, c_name AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_mktsegment = 'BUILDING'",
    "f5_link_filter": _WEB + f""", claimed AS (SELECT url FROM known WHERE status = 'unseen'), got AS (SELECT c.url, links FROM claimed c JOIN page USING (url)),
n AS (SELECT DISTINCT {normal('l')} AS u FROM (SELECT unnest(links) AS l FROM got) WHERE length(l) % 2 = 0)
SELECT (SELECT count(*) FROM got) AS crawled, (SELECT count(*) FROM claimed) - (SELECT count(*) FROM got) AS errors, (SELECT count(*) FROM n WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM known)) AS "linksFound" """,
    "c2_dates": "WITH p AS (SELECT doc_id, doc_id % 20000 AS k FROM documents) SELECT doc_id, coalesce(" + ", ".join([f"CASE WHEN k % 7 = 0 THEN {_date(7)} END"] + [f"CASE WHEN k % {i + 2} = 0 THEN {_date(i)} END" for i in range(6)]) + ") AS published FROM p",
    "c6_parse_page": rf"""WITH h AS (SELECT url, html, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM seed_pages)
SELECT url, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title, coalesce(string_split(url, '/')[4], '') AS "repoOwner", true AS "lowContent",
  CAST((SELECT count(DISTINCT {normal("regexp_extract(url, '^(https?://[^/?#]+)', 1) || x")}) FROM (SELECT unnest(l) AS x)) AS INT) AS n_links, CAST(0 AS INT) AS n_text FROM h""",
    "d4_trending": f"""WITH f AS (SELECT unnest(regexp_extract_all(html, 'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"', 1)) AS p FROM seed_pages WHERE page % 5 <> 0)
SELECT DISTINCT '{BASE}/' || p AS url FROM f WHERE lower(split_part(p, '/', 1)) NOT IN ({_list(RESERVED_OWNERS)})""",
    "d6_seed_frontier": FRONTIER + ", " + _TOPIC_LINKS.removeprefix("WITH ").replace("page <= 10", "page <= 3") + f""",
t AS (SELECT unnest(regexp_extract_all(html, 'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"', 1)) AS p FROM seed_pages),
s AS (SELECT url FROM seeds UNION SELECT '{BASE}/' || p FROM t WHERE lower(split_part(p, '/', 1)) NOT IN ({_list(RESERVED_OWNERS)})),
n AS (SELECT DISTINCT {normal('url')} AS u FROM s), c AS (SELECT (SELECT count(*) FROM n WHERE u NOT IN (SELECT url FROM known)) AS added, (SELECT count(*) FROM s) AS discovered)
SELECT added, discovered - added AS skipped, discovered, (SELECT count(*) FROM known) + added AS "frontierSize" FROM c""",
    "f1_rate_limit": _WAITS,
    "f3_crawl_one": URLS + f""", j AS (SELECT url, {_N} AS n, CASE WHEN {_N} % 11 = 0 THEN 'error: timed out' WHEN {_N} % 8 > 5 THEN 'too-many-redirects' WHEN {_N} % 7 = 0 THEN 'http-status' WHEN {_N} % 6 = 0 THEN 'content-type'
  WHEN {_N} % 13 = 0 THEN 'too-large' WHEN {_N} % 5 = 0 THEN 'disallowed-redirect' END AS reason FROM u)
SELECT url, CASE WHEN n % 11 = 0 THEN url ELSE 'https://code.example/' || CASE WHEN n % 5 = 0 THEN 'x' ELSE 'o' END || '/' || n END AS final_url, reason,
  CASE WHEN reason IS NULL THEN '' || n ELSE '' END AS title, CASE WHEN reason IS NULL THEN 'read ' || n ELSE '' END AS text, CASE WHEN reason IS NULL THEN 'https://code.example/a/' || n ELSE '' END AS links FROM j""",
    "f6_crawl_rounds": FRONTIER + """, page AS (SELECT doc_key AS url, links FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY fetchedAt DESC NULLS LAST, links DESC NULLS LAST) AS r FROM docs WHERE doc_key IS NOT NULL) WHERE r = 1),
f0 AS (SELECT url, status FROM known)""" + _round(0, 50) + _round(1, 50) + " " + _STATS + "f2",
    # every URL that the unseen ones lead to is visited in the end, whatever the order
    "f7_crawl_until_idle": _WEB.replace("WITH ranked", "WITH RECURSIVE ranked", 1) + f""",
edges AS (SELECT DISTINCT url, {normal('l')} AS dst FROM (SELECT url, unnest(links) AS l FROM page)),
visited AS (SELECT url FROM known WHERE status = 'unseen' UNION SELECT e.dst FROM visited v JOIN edges e ON e.url = v.url WHERE e.dst IS NOT NULL AND e.dst NOT IN (SELECT url FROM known)),
f AS (SELECT url, CASE WHEN url IN (SELECT url FROM page) THEN 'seen' ELSE 'error' END AS status FROM visited UNION ALL SELECT url, status FROM known WHERE status IS NULL OR status <> 'unseen') {_STATS} f""",
    "a1_tokenize": PAGES + f""", cut AS (SELECT doc_key, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: NOT list_contains([{_list(stop_words())}], x)) AS l FROM pages),
tok AS (SELECT doc_key, i - 1 AS pos, l[i] AS token FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM cut)), """ + stems("tok") + " SELECT doc_key, CAST(pos AS INT) AS pos, term FROM tok JOIN stems USING (token)",
    "a2_stopword_filter": PAGES + KEPT + " SELECT token, count(*) AS n FROM tok GROUP BY token",
    "a3_stem_vocab": PAGES + RAW + ", " + stems("raw") + " SELECT token, term FROM stems",
    "a4_term_frequencies": COUNTS + " SELECT doc_key, term, tf FROM counts",
    "a6_query_terms": "WITH " + _query_terms(_HITS) + " SELECT query_id, CAST(pos AS INT) AS pos, term FROM qt",
    "a8_round4": f"SELECT query_id, url, {_round4('tfidf')} AS r FROM hits WHERE tfidf IS NOT NULL",
    "a9_ln_idf": STATE + " SELECT term, count(*) AS df, round(ln(((SELECT count(DISTINCT doc_key) FROM docs)::DOUBLE + 1) / (count(*) + 1)), 8) AS idf FROM state GROUP BY term",
    "b1_normalize_url": URLS + f" SELECT url, {normal('url')} AS normal FROM u",
    "b2_company_tag": URLS + f""", l AS (SELECT url, string_split({_HOST}, '.') AS l FROM u)
SELECT url, coalesce(list_filter(l, lambda x: NOT list_contains([{_list(SKIPPED_LABELS + TOP_LABELS)}], x))[1], l[1], 'unknown') AS tag FROM l""",
    "b3_allowed_path": _MADE + f" SELECT url, {_PREFIX} AS ok FROM u",
    "b4_domain_allowed": _MADE + f" SELECT url, {_domains(['code.example', 'mill.example'])} AS ok FROM u",
    "b5_policy": _MADE + f" SELECT raw AS url, coalesce(url IS NOT NULL AND {_domains(['code.example'])} AND {_PREFIX}, false) AS ok FROM (SELECT url AS raw, {normal('url')} AS url FROM u)",
    "b7_repo_url_policy": f"""WITH u AS (SELECT p || s AS url FROM (SELECT DISTINCT regexp_replace(doc_key, '^https?://[^/]+', 'https://github.com') AS p FROM docs), (SELECT unnest([{_list(SUFFIXES)}]) AS s) WHERE p IS NOT NULL)
SELECT url, {_HOST} = 'github.com' AND NOT regexp_matches({_PATH}, '{REPO_BLOCKED}') AND regexp_matches({_PATH}, '{REPO_ALLOWED}') AS ok FROM u""",
    "b8_resolve_link": f"""SELECT url, href, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS target
FROM (SELECT DISTINCT url FROM docs), (SELECT unnest([{_list(HREFS)}]) AS href)""",
    "b9_domain": URLS + f" SELECT {_HOST} AS domain, count(*) AS n FROM u GROUP BY 1",
    "b10_path_segments": URLS + " SELECT url, coalesce(string_split(url, '/')[4], '') AS owner, coalesce(string_split(url, '/')[5], '') AS name FROM u",
    "c3_title": "SELECT url, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM seed_pages",
    "c4_links": rf"""WITH a AS (SELECT url, list_distinct_in_order AS l FROM (SELECT url, list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN list_position(h, h[i]) = i THEN h[i] END), lambda x: x IS NOT NULL) AS list_distinct_in_order
  FROM (SELECT url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM seed_pages)))
SELECT url, CAST(i - 1 AS INT) AS pos, {normal("regexp_extract(url, '^(https?://[^/?#]+)', 1) || l[i]")} AS link FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM a)""",
    "c7_repo_links": f"""WITH f AS (SELECT url, list_filter(regexp_extract_all(html, 'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"', 1), lambda p: NOT list_contains([{_list(RESERVED_OWNERS)}], lower(split_part(p, '/', 1)))) AS h FROM seed_pages),
d AS (SELECT url, list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN list_position(h, h[i]) = i THEN h[i] END), lambda x: x IS NOT NULL) AS l FROM f)
SELECT url, CAST(i - 1 AS INT) AS pos, '{BASE}/' || l[i] AS repo FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)""",
    "d1_fetch_rules": """SELECT CASE WHEN k % 8 > 5 THEN 'too-many-redirects' WHEN k % 7 = 0 THEN 'http-status' WHEN k % 5 = 0 THEN 'content-type' WHEN k % 4000000 > 2097152 THEN 'too-large' ELSE 'ok' END AS verdict,
  count(*) AS n FROM (SELECT coalesce(addedAt, 0) AS k FROM frontier) GROUP BY 1""",
    "d3_topic_pages": _TOPIC_LINKS + " SELECT topic, page, url FROM seeds",
    "d5_seed_union": FRONTIER + ", " + _TOPIC_LINKS.removeprefix("WITH ") + f""", s AS (SELECT DISTINCT url FROM seeds), n AS (SELECT DISTINCT {normal('url')} AS u FROM s)
SELECT (SELECT count(*) FROM n WHERE u NOT IN (SELECT url FROM known)) AS added, (SELECT count(*) FROM s) - (SELECT count(*) FROM n WHERE u NOT IN (SELECT url FROM known)) AS skipped, (SELECT count(*) FROM s) AS discovered""",
    "d8_store_scan": "SELECT DISTINCT c_name AS key FROM customer WHERE c_mktsegment = 'BUILDING'",
    "e1_frontier_add": INCOMING + " SELECT url, added, reason FROM judged",
    "e2_add_batch": INCOMING + " SELECT count(*) FILTER (added) AS added, count(*) FILTER (NOT added) AS skipped FROM judged",
    "e3_claim": FRONTIER + " SELECT url FROM known WHERE status = 'unseen' ORDER BY sha256(url || '7'), url LIMIT 100",
    "e4_mark_error": FRONTIER + f""" SELECT url, CASE WHEN status = 'seen' THEN 'error' ELSE status END AS status, CASE WHEN status = 'seen' THEN 'timeout' ELSE error END AS error, CASE WHEN status = 'seen' THEN {NOW} ELSE errorAt END AS errorAt FROM known
UNION ALL SELECT 'https://new.example/', 'error', 'unknown', {NOW}""",
    "e5_stats": FRONTIER + " SELECT count(*) FILTER (status = 'unseen') AS unseen, count(*) FILTER (status = 'seen') AS seen, count(*) FILTER (status = 'error') AS error, count(*) AS total FROM known",
    "e6_get": FRONTIER + " SELECT url, status FROM known WHERE url = (SELECT min(url) FROM known)",
    "f2_schedule": """WITH a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000)) - 1 AS i FROM events)
SELECT event_id, user_id, arrival, max(arrival - 3600000 * i) OVER (PARTITION BY user_id ORDER BY i) + 3600000 * i AS start FROM a""",
    "f4_crawl_batch": FRONTIER + f""", claimed AS (SELECT url FROM known WHERE status = 'unseen' ORDER BY sha256(url || '7'), url LIMIT 500),
page AS (SELECT doc_key AS url, links FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY fetchedAt DESC NULLS LAST, links DESC NULLS LAST) AS r FROM docs WHERE doc_key IS NOT NULL) WHERE r = 1),
got AS (SELECT c.url, links FROM claimed c JOIN page USING (url)),
n AS (SELECT DISTINCT {normal('l')} AS u FROM (SELECT unnest(links) AS l FROM got))
SELECT (SELECT count(*) FROM got) AS crawled, (SELECT count(*) FROM claimed) - (SELECT count(*) FROM got) AS errors, (SELECT count(*) FROM n WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM known)) AS linksFound""",
    "f9_link_graph": """WITH p AS (SELECT doc_key AS src, max(links) AS l FROM docs WHERE doc_key IS NOT NULL GROUP BY doc_key)
SELECT src, CAST(i - 1 AS INT) AS pos, l[i] AS dst FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p) WHERE l[i] IS NOT NULL""",
    "g1_mapreduce_generic": PAGES + RAW + " SELECT token AS key, count(*) AS n FROM raw GROUP BY token",
    "g2_order_lists": "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "g7_mr_index": PAGES + RAW + " SELECT token, count(DISTINCT doc_key) AS df, count(*) AS total FROM raw GROUP BY token",
    "h1_postings": COUNTS + f" SELECT doc_key AS url, term, tf, repoOwner, array_to_string(topics, ',') AS topics, isFork, isArchived, lowContent, lastCommitDate FROM counts JOIN pages USING (doc_key)",
    "h2_inverted_index": COUNTS + " SELECT term, count(*) AS n, string_agg(doc_key || ':' || tf, ' ' ORDER BY doc_key) AS list FROM counts GROUP BY term",
    "h3_indexer_stats": COUNTS + " SELECT count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM counts",
    "h4_lookup": STATE + " SELECT term, url, tf FROM state WHERE term = 'worker'",
    "h5_index_stats": "SELECT count(DISTINCT term) AS termCount FROM postings WHERE term <> '' AND url IS NOT NULL",
    "h6_doc_frequency": "SELECT term, count(DISTINCT url) AS df FROM postings WHERE term <> '' AND url IS NOT NULL GROUP BY term",
    "i1_search": _search("SELECT CAST(1 AS BIGINT) AS query_id, 'archived worker limits and files' AS query"),
    "i1_search_batch": _search(_HITS),
    "i3_or_aggregate": _found(_HITS) + f" SELECT query_id, url, {_round4('x')} AS tfidf, matched FROM found",
    "i3_term_details": _found(_HITS) + f" SELECT query_id, url, term, tf, {_round4('idf')} AS idf, {_round4('tf * idf')} AS tfidf FROM m",
    "i4_recency": f"SELECT lastCommitDate, {_round4(_recency('lastCommitDate'))} AS recency FROM (SELECT DISTINCT lastCommitDate FROM docs)",
    "i5_pagerank_join": """WITH pr AS (SELECT url, g, o FROM (SELECT url, global AS g, repoOwner AS o, row_number() OVER (PARTITION BY url ORDER BY global DESC NULLS LAST, repoOwner DESC NULLS LAST) AS r FROM pagerank) WHERE r = 1)
SELECT d.url, coalesce(nullif(g, 0), 0.5) AS g, coalesce(nullif(o, 0), 0.5) AS o FROM (SELECT DISTINCT doc_key AS url FROM docs WHERE doc_key IS NOT NULL) d LEFT JOIN pr ON pr.url = d.url""",
    "i6_max_norm": _found(_HITS) + f", best AS (SELECT query_id, greatest(max(x), 0.0) AS b FROM found GROUP BY query_id) SELECT query_id, url, {_round4('x / (CASE WHEN b = 0 THEN 1.0 ELSE b END)')} AS norm FROM found JOIN best USING (query_id)",
    "i7_penalties": _scored(_HITS) + f" SELECT query_id, url, {_round4('t')} AS tfidf, {_round4('r')} AS recency FROM scored",
    "i8_blend": _scored(_HITS) + " SELECT query_id, url, score FROM scored",
    "i9_topn": _scored(_HITS) + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM scored) SELECT query_id, CAST(rank AS INT) AS rank, url, score FROM ranked WHERE rank <= 5",
    "i10_total_matches": _found(_HITS) + " SELECT query_id, count(*) AS n FROM found GROUP BY query_id",
    "j1_kv_put": LOG + ", l AS (SELECT gid, key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log WHERE op <> 'append' GROUP BY ALL) SELECT gid, key, value FROM l WHERE op = 'put'",
    "j2_kv_get": FOLD + " SELECT gid, key, v FROM fold WHERE key = 'u1'",
    "j3_kv_keys": FOLD + " SELECT gid, key FROM fold",
    "j4_kv_del": LOG + """, d AS (SELECT key, seq, coalesce((SELECT max(l.seq) FROM log l WHERE l.key = x.key AND l.seq < x.seq AND l.op <> 'del'), -1) > coalesce((SELECT max(l.seq) FROM log l WHERE l.key = x.key AND l.seq < x.seq AND l.op = 'del'), -1) AS found FROM log x WHERE op = 'del')
SELECT found, count(*) AS n FROM d GROUP BY found""",
    "j5_kv_append": FOLD + " SELECT gid, key, v, is_list FROM fold",
    "j6_reconf_plan": KEYS + f", {_nodes(3, 'old')}, {_nodes(4, 'new')} SELECT a.key, a.nid AS from_nid, b.nid AS to_nid FROM {_RENDEZVOUS.format('old')} a JOIN {_RENDEZVOUS.format('new')} b USING (key) WHERE a.nid <> b.nid",
    "j8_key_codec": """WITH k AS (SELECT DISTINCT doc_key AS key FROM docs WHERE doc_key IS NOT NULL), b AS (SELECT key FROM k UNION ALL SELECT repeat(key, 6) FROM k)
SELECT key, CASE WHEN 2 * octet_length(encode(key)) > 250 THEN 'H' || sha256(key) ELSE lower(hex(encode(key))) END AS name, CASE WHEN 2 * octet_length(encode(key)) <= 250 THEN key END AS back FROM b""",
    "k1_get_id": KEYS + " SELECT key, kid AS id FROM keys",
    "k2_nid_sid": f"WITH {_nodes(4)} SELECT ip, port, nid, left(nid, 5) AS sid FROM nodes",
    "k3_message_id": "SELECT event_id, sha256('{\"date\":' || (epoch_us(ts) // 1000) || ',\"mss\":\"' || event_type || '\"}') AS mid FROM events",
    "k5_naive": KEYS + f""", {_nodes(3)}, s AS (SELECT list_sort(list(nid)) AS l FROM nodes),
d AS (SELECT key, list_reduce(list_transform(string_split(kid, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: (a * 16 + c) % 3) AS r FROM keys)
SELECT key, l[CAST(r % 3 AS INT) + 1] AS nid FROM d, s""",
    "k6_consistent": KEYS + f", {_nodes(3)} SELECT key, coalesce(min(nid) FILTER (nid >= kid), min(nid)) AS nid FROM keys, nodes GROUP BY key",
    "k7_rendezvous": KEYS + f", {_nodes(3)} SELECT key, nid FROM {_RENDEZVOUS.format('nodes')}",
    "k9_load": KEYS + f", {_nodes(3)} SELECT nid, count(*) AS n FROM {_RENDEZVOUS.format('nodes')} GROUP BY nid",
    "l3_group_members": "SELECT CAST(user_id % 5 AS VARCHAR) AS gid, CAST(user_id AS VARCHAR) AS sid FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'",
    "l7_gossip_targets": "SELECT CAST(s_suppkey AS VARCHAR) AS from_nid, greatest(1, CAST(ceil(ln((SELECT count(*) FROM supplier))) AS BIGINT)) AS n FROM supplier",
    "l5_status_sum": "SELECT user_id % 12 AS sid, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY ROLLUP (user_id % 12)",
    "l8_gossip_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "n2_status": FRONTIER + """ SELECT (SELECT count(DISTINCT term) FROM postings WHERE term <> '') AS termCount, (SELECT count(DISTINCT doc_key) FROM docs) AS docs,
  count(*) FILTER (status = 'unseen') AS unseen, count(*) FILTER (status = 'seen') AS seen, count(*) FILTER (status = 'error') AS error, count(*) AS total FROM known""",
}

#: Streams must end with what the batch form gives.
STREAMS = {
    "s1_stream_index": COUNTS + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term",
    "s2_stream_frontier": FRONTIER + f" SELECT DISTINCT {normal('url')} AS url, 'unseen' AS status FROM (SELECT unnest(links) AS url FROM docs) WHERE {normal('url')} IS NOT NULL AND {normal('url')} NOT IN (SELECT url FROM known WHERE status = 'seen')",
    "s4_stream_rate_limit": _WAITS,
    "s3_stream_gossip": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
