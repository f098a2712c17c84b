"""Queries of the training-text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from termloom.durable import durable, if_small
from termloom.llm import markup, mixing, neardup, packing, postings, quality, rankfuse, repeated_lines, tokens
from termloom.llm.shingles import words_of
from termloom.tables import load

SCORES = ["tfidf", "pagerank_global", "pagerank_repoOwner", "recency"]
CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = repeated_lines.repeated_positions(load(spark, sf_dir, "docs"), "doc_key", "repoOwner", "text", common=True)
    return at.select(F.col("key").alias("doc_key"), F.col("line_no").cast("int").alias("line_no"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(load(spark, sf_dir, "docs"), "doc_key", "repoOwner", "text", common=True)


def p1_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of p1_found those in significant excess over the other owners."""
    at = repeated_lines.repeated_positions(load(spark, sf_dir, "docs"), "doc_key", "repoOwner", "text")
    return at.select(F.col("key").alias("doc_key"), F.col("line_no").cast("int").alias("line_no"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "docs")
    return neardup.alike_pairs(docs, "doc_key", "text", 3, 0.5, 50).select("key_a", "key_b").toDF("doc_key_a", "doc_key_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.alike_groups(load(spark, sf_dir, "docs"), "doc_key", "text", 3, 0.5)


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_marks(postings.latest_tf(load(spark, sf_dir, "postings")), 1, 0.54)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark <> 'useful'").select("term", "mark")


def p5_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_marks(postings.text_terms(load(spark, sf_dir, "docs"), "doc_key", words_of(F.col("text"))), 1, 0.54)


def p6_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = postings.association(postings.latest_tf(load(spark, sf_dir, "postings")))
    return scored.drop("pmi").withColumn("ppmi", F.round("ppmi", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = postings.association(postings.latest_tf(load(spark, sf_dir, "postings")))
    # counts alone make a case, as in the SQL; the score decides their order, the most characteristic first
    cases = scored.where("tf >= 5 AND records BETWEEN 2 AND 8")
    return cases.orderBy(F.desc("ppmi"), "url", "term").select("url", "term")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rankfuse.fused_ranking(load(spark, sf_dir, "hits"), "query_id", "url", SCORES, "scored_at", [0.65, 0.2, 0.1, 0.05])
    return fused.withColumn("fused", F.round("fused", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = p4_ranking(spark, sf_dir)
    return ranked.where(" AND ".join(f"greater_{s} <= 2" for s in SCORES)).select("query_id", "url")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = markup.clean_texts(load(spark, sf_dir, "docs"), "doc_key", "repoOwner", "text")
    return cleaned.dropDuplicates(["doc_key"]).withColumn("kinds", F.array_join("kinds", ","))


def p7_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its kinds, and the text of those without markup, which must be as it was."""
    return p7_clean(spark, sf_dir).select("doc_key", "kinds", F.when(F.col("kinds") == "", F.col("text")).alias("plain"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = markup.clean_texts(load(spark, sf_dir, "docs"), "doc_key", "repoOwner", "text")
    return cleaned.select("doc_key", F.explode("kinds").alias("kind")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = durable(tokens.token_sizes(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.pack(sized, "doc_id", "n_tokens", CAPACITY)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing by the operator, summed up: what is in it must be what the table has, in few containers, none too full."""
    sized = load(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    packed = durable(packing.pack(sized, "doc_id", "size", 8 * CAPACITY))
    report = packing.packing_report(packed, "doc_id", 8 * CAPACITY)
    near = F.col("containers") <= F.ceil(1.01 * F.col("least_containers")) + 1
    return report.select("pieces", "total_size", "least_containers", "overfull", near.alias("near_least"), packed.agg(F.countDistinct("doc_id", "piece").alias("n")).scalar().alias("distinct_pieces"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_containers(spark, sf_dir).where("piece > 0").select("doc_id").distinct()


def _mix(spark: SparkSession, sf_dir: str, count=None, parts: tuple[float, ...] = ()) -> tuple[DataFrame, DataFrame]:
    targets = durable(mixing.targets_of(load(spark, sf_dir, "mix_targets"), "source", "target_weight", "max_repeats"))
    docs = load(spark, sf_dir, "documents").withColumn("name", mixing.source_name(F.col("source"))).join(if_small(targets.select("name")), "name", "left_semi")
    sized = durable(tokens.token_sizes(docs, "doc_id", "text", ("name",)).toDF("key", "name", "size") if count is None else docs.select(F.col("doc_id").alias("key"), "name", count.alias("size")))
    totals = [None] if not parts else [p * (sized.agg(F.sum("size")).first()[0] or 0) for p in parts]
    plan = durable(mixing.budgets(sized, targets, totals))
    return mixing.mix(sized, plan), plan


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].drop("budget").withColumnsRenamed({"key": "doc_id", "name": "source", "size": "n_tokens"})


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir)).drop("budget")


def p9_char_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draw over sizes in characters, for three budgets that lie within one another."""
    drawn = _mix(spark, sf_dir, F.coalesce(F.length("text"), F.lit(0)).cast("bigint"), (0.125, 0.5, 1.0))[0]
    return drawn.select(F.col("key").alias("doc_id"), F.col("name").alias("source"), F.col("size").alias("n_chars"), "budget", "uses")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the draw itself: every text as often as allowed, and still under the target."""
    return p9_shares(spark, sf_dir).where("short").select("source")


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = durable(quality.text_statistics(load(spark, sf_dir, "documents"), load(spark, sf_dir, "common_words")))
    return quality.quality(stats)


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics without the sentence share."""
    stats = quality.text_statistics(load(spark, sf_dir, "documents"), load(spark, sf_dir, "common_words"))
    return stats.select("doc_id", *[F.round(s, 6).alias(s) for s in quality.STATISTICS[:-1]])


def p10_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail scores of statistics that SQL has too: characters, lines, and the share of letters a to z."""
    letters = F.length(F.regexp_replace(F.lower("text"), "[^a-z]+", "")) / F.length("text")
    rows = load(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", "lang", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks"), letters.alias("letters"))
    scored = quality.tail_scores(durable(rows), "doc_id", "lang", ("chars", "breaks", "letters"), ("letters", 0.5))
    return scored.select("doc_id", "n_total", F.round("outlier", 6).alias("outlier"), F.round("nats", 6).alias("nats"), F.round("bound", 6).alias("bound"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality(spark, sf_dir).where(~F.col("natural")).select("doc_id")


QUERIES = {
    "p4_found": p4_found, "p4_ranking": p4_ranking,
    "p7_found": p7_found, "p7_clean": p7_clean, "p7_plain": p7_plain,
    "p8_found": p8_found, "p8_containers": p8_containers, "p8_report": p8_report,
    "p9_found": p9_found, "p9_shares": p9_shares, "p9_uses": p9_uses, "p9_char_uses": p9_char_uses,
    "p10_found": p10_found, "p10_quality": p10_quality, "p10_tails": p10_tails, "p10_statistics": p10_statistics,
    "p1_found": p1_found, "p1_clean": p1_clean, "p1_excess": p1_excess,
    "p2_found": p2_found, "p2_groups": p2_groups,
    "p5_found": p5_found, "p5_terms": p5_terms, "p5_text_terms": p5_text_terms,
    "p6_found": p6_found, "p6_association": p6_association,
}

_STATE = """
WITH kept AS (SELECT term, url, coalesce(tf, 1) AS tf, indexedAt FROM postings WHERE term <> '' AND url IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term, url ORDER BY indexedAt DESC NULLS LAST, tf DESC) AS r FROM kept),
state AS (SELECT term, url, tf FROM ranked WHERE r = 1)"""

_MARKS = """, n AS (SELECT count(DISTINCT url) AS n FROM state),
marks AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS records,
  CASE WHEN count(*) <= 1 THEN 'rare' WHEN count(*) >= 0.54 * (SELECT n FROM n) THEN 'common' ELSE 'useful' END AS mark
  FROM state GROUP BY term)
"""

_LINES = """
WITH pages AS (SELECT DISTINCT doc_key, lower(trim(repoOwner)) AS owner, text FROM docs
               WHERE doc_key IS NOT NULL AND trim(repoOwner) <> ''),
cut AS (SELECT doc_key, owner, string_split(text, chr(10)) AS l FROM pages WHERE text IS NOT NULL),
lines AS (SELECT doc_key, owner, i AS line_no, trim(regexp_replace(lower(l[i]), '[^a-z]+', ' ', 'g')) AS s
          FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM cut)),
many AS (SELECT owner, count(DISTINCT doc_key) AS n FROM pages GROUP BY owner),
often AS (SELECT owner, s FROM lines JOIN many USING (owner) WHERE length(s) >= 20 GROUP BY owner, s, n
          HAVING count(DISTINCT doc_key) >= 4 AND count(DISTINCT doc_key) >= 0.25 * n)
"""

def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def _quantile(p: str) -> str:
    a, b, c, d = rankfuse.QUANTILE
    q, low, high = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"""(CASE WHEN {p} < 0.02425 THEN {_poly(c, low)} / {_poly(d, low)} WHEN {p} > 1 - 0.02425 THEN -{_poly(c, high)} / {_poly(d, high)}
  ELSE {_poly(a, f"{q} * {q}")} * {q} / {_poly(b, f"{q} * {q}")} END)"""


def _part(k: str, expected: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({k} / ({expected})) ELSE 0 END"


def _percentile(score: str) -> str:
    """Rank with ties averaged, less a half, over the number of the query's urls; null is least."""
    return f"""((rank() OVER (PARTITION BY query_id ORDER BY {score} NULLS FIRST) - 1
  + count(*) OVER (PARTITION BY query_id, {score}) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id))"""


_NOW = """
WITH now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url
    ORDER BY scored_at DESC NULLS LAST, tfidf DESC NULLS LAST, pagerank_global DESC NULLS LAST, pagerank_repoOwner DESC NULLS LAST, recency DESC NULLS LAST) AS r
  FROM hits WHERE query_id IS NOT NULL AND url IS NOT NULL) WHERE r = 1)"""

_SPLIT = """, c AS (SELECT doc_key, text, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT doc_key, text FROM docs WHERE doc_key IS NOT NULL)),
gone AS (SELECT doc_key, list(DISTINCT line_no) AS g FROM lines JOIN often USING (owner, s) GROUP BY doc_key)
"""

_PIECES = r"len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+'))"
#: (name, share, repeats, size) of every record of a listed source; size by an expression over text.
_SIZED = """
WITH w AS (SELECT lower(trim(source)) AS name, min(source) AS source, sum(target_weight) AS w, max(greatest(0, coalesce(max_repeats, 1))) AS repeats
  FROM mix_targets WHERE source IS NOT NULL AND target_weight > 0 GROUP BY 1),
t AS (SELECT name, source, repeats, w / (SELECT sum(w) FROM w) AS share FROM w),
d AS (SELECT doc_id, t.name, coalesce({size}, 0) AS size FROM documents JOIN t ON lower(trim(documents.source)) = t.name),
have AS (SELECT t.name, t.source, t.share, t.repeats, coalesce(sum(size), 0) AS have FROM t LEFT JOIN d USING (name) GROUP BY ALL),
total AS (SELECT sum(have) AS total FROM have)
"""

# the constructs of each kind for an engine without look-around, over a text with LF line ends; word characters of any script
_W = r"\p{L}\p{N}_"
_CONSTRUCTS = {
    "html": [r"(?i:</?(?:" + "|".join(markup.TAGS) + r")(?:[\s/][^<>]*)?>|<!--|<!doctype\b|&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot|copy|reg)(?:[^a-z0-9=;]|$))"],
    "markdown": [
        r"^ {0,3}#{1,6}[ \t]+\S", r"^ {0,3}\S[^\n|]*\n {0,3}(?:={3,}|-{3,})[ \t]*$", r"^ {0,3}(?:```+|~~~+)[^\n`~]*$", r"^ {0,3}>[ \t]?\S", r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\][ \t]+\S",
        r"^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", r'\[[^\[\]\n]+\]\([^()\s]+(?:[ \t]+"[^"\n]*")?\)', rf"(?:^|[^{_W}\]])\[[^\[\]\n]+\]\[\w[^\[\]\n]*\]",
        r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S", r"\[\^[^\[\]\s]+\]", r"(?:^|[^`])`[^`\n]+`(?:[^`]|$)",
        *[rf"(?:^|[^{_W}*\\])\*{{{k}}}(?:[^\s*\\]{{1,2}}|[^\s*][^*\n]*[^\s*\\]{{2}})\*{{{k}}}(?:[^{_W}*]|$)" for k in (1, 2, 3)],
        rf"(?:^|[^{_W}\\])_[^\s_](?:[^_\n]*[^\s_])?_(?:[^{_W}]|$)", rf"(?:^|[^{_W}\\])__[^\s_][^_\n]*[ \t][^_\n]*[^\s_]__(?:[^{_W}]|$)", rf"(?:^|[^{_W}~])~~[^\s~](?:[^~\n]*[^\s~])?~~(?:[^{_W}~]|$)",
    ],
    "wiki": [
        r"""\[\[(?:[A-Za-z][^\[\]\n]*|[^\[\]\n\d\s,'"][^\[\]\n]*[A-Za-z][^\[\]\n]*)\]\]""", rf"(?:^|[^{_W}'])'{{2,3}}[^\s'](?:[^'\n]*(?:'[^'\n]+)*[^\s'])?'{{2,3}}(?:[^{_W}']|$)", *[rf"^={{{k}}}[^=\n]*[^=\s][^=\n]*={{{k}}}[ \t]*$" for k in range(2, 7)],
        r"\{\{[A-Za-z#:][^{}]*\}\}", r"^\{\|", r"^\|-[ \t]*$", r"^\|\}", "__(?:" + "|".join(markup.SWITCHES) + ")__", r"^#REDIRECT\b", r"\[https?://\S+[ \t]+[^\[\]\n]+\]", r"</?(?:nowiki|ref)\b[^<>]*>",
    ],
    "latex": [
        r"(?:^|[^:\\])\\[A-Za-z]+\*?\{", rf"""(?:^|[^{_W}:\\."'])\\[A-Za-z]+\*?(?:[\s{{}}\[\]()$,;.^_~&=]|$)""", r"\$\$[^$]+\$\$", rf"(?:^|[^{_W}\\])\\\([^\n]+?\\\)", r"^[ \t]*\\\[(?s:.*?)\\\]",
        rf"(?:^|[^{_W}$\\])\$(?:[^\s$][^$\n]*)?(?:\\[A-Za-z]|[\^_=])(?:[^$\n]*[^\s$])?\$(?:[^{_W}$]|$)",
    ],
}
_MARKUP = "WITH t AS (SELECT DISTINCT doc_key, replace(text, chr(13), '') AS text FROM docs WHERE doc_key IS NOT NULL AND text IS NOT NULL)\n" + "\nUNION ALL ".join(
    f"SELECT doc_key, '{kind}' AS kind FROM t WHERE " + " OR ".join("regexp_matches(text, '(?m)" + p.replace("'", "''") + "')" for p in patterns) for kind, patterns in _CONSTRUCTS.items()
)

_LEFT, _RIGHT = "-ln(cume_dist() OVER (PARTITION BY lang ORDER BY {0}))", "-ln(cume_dist() OVER (PARTITION BY lang ORDER BY {0} DESC))"
_LETTERS = "length(regexp_replace(lower(text), '[^a-z]+', '', 'g')) / length(text)::DOUBLE"

ORACLES = {
    "p4_ranking": _NOW + """,
p AS (SELECT query_id, url, """ + ", ".join(f"{_percentile(s)} AS p{i}, count(*) OVER (PARTITION BY query_id) - rank() OVER (PARTITION BY query_id ORDER BY {s} NULLS FIRST) + 1 - count(*) OVER (PARTITION BY query_id, {s}) AS greater_{s}" for i, s in enumerate(SCORES)) + """ FROM now),
z AS (SELECT query_id, url, round((0.65::DOUBLE * """ + " + ".join(f"{w}{_quantile(f'p{i}')}" for i, w in enumerate(("", "0.2::DOUBLE * ", "0.1::DOUBLE * ", "0.05::DOUBLE * "))) + """) / 1.0, 9) AS fused,
  """ + ", ".join(f"greater_{s}" for s in SCORES) + """ FROM p)
SELECT query_id, url, round(fused, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, url) AS position, """ + ", ".join(f"greater_{s}" for s in SCORES) + " FROM z",
    "p1_clean": _LINES + _SPLIT + """SELECT doc_key, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text,
  CAST(coalesce(len(g), 0) AS INT) AS n_removed FROM c LEFT JOIN gone USING (doc_key)""",
    "p2_groups": """
WITH RECURSIVE pages AS (SELECT DISTINCT doc_key, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM docs WHERE doc_key IS NOT NULL),
named AS (SELECT doc_key, w, min(doc_key) OVER (PARTITION BY w) AS cls, count(*) OVER (PARTITION BY w) AS n_copies FROM pages),
sh AS (SELECT DISTINCT cls, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT cls, w, unnest(range(1, len(w) - 1)) AS i FROM named WHERE doc_key = cls AND len(w) >= 3)),
size AS (SELECT cls, count(*) AS n FROM sh GROUP BY cls),
links AS (SELECT x, y FROM (SELECT a.cls AS x, b.cls AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.cls < b.cls GROUP BY 1, 2)
  JOIN size p ON p.cls = x JOIN size q ON q.cls = y WHERE k >= 0.5 * (p.n + q.n - k)),
ways AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT u, v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON w.u = r.v),
least AS (SELECT u AS cls, least(min(v), u) AS group_id FROM reach GROUP BY u),
degree AS (SELECT u AS cls, count(*) AS n_links FROM ways GROUP BY u)
SELECT doc_key, cls AS class_id, coalesce(group_id, cls) AS group_id, coalesce(n_links, 0) AS n_links, n_copies FROM named LEFT JOIN least USING (cls) LEFT JOIN degree USING (cls)
""",
    "p7_found": _MARKUP,
    "p7_plain": "WITH m AS (" + _MARKUP + "), k AS (SELECT doc_key, string_agg(kind, ',' ORDER BY list_position(['html', 'markdown', 'wiki', 'latex'], kind)) AS kinds FROM m GROUP BY doc_key)\n"
    "SELECT doc_key, coalesce(kinds, '') AS kinds, CASE WHEN kinds IS NULL THEN text END AS plain FROM (SELECT DISTINCT doc_key, text FROM docs WHERE doc_key IS NOT NULL) LEFT JOIN k USING (doc_key)",
    "p10_statistics": r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+') AS w, regexp_extract_all(text, '[㐀-䶿一-鿿]') AS han, length(regexp_replace(text, '\s+', '', 'g')) AS bare,
  list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x, E' \t\f\v')), lambda x: x <> '') AS lines FROM documents WHERE regexp_matches(text, '\S')),
c AS (SELECT doc_id, w, han, bare, lines, length(array_to_string(w, '')) AS letters, len(w) AS n0, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS signs FROM d),
n AS (SELECT *, CASE WHEN letters > 12 * n0 THEN n0 + len(han) - len(list_filter(w, lambda x: regexp_matches(x, '^[㐀-䶿一-鿿]'))) ELSE n0 END AS n FROM c),
t AS (SELECT doc_id, unnest(w) AS word FROM d), known AS (SELECT doc_id, lang, count(*) AS k FROM t JOIN (SELECT DISTINCT lang, lower(word) AS word FROM common_words WHERE word IS NOT NULL) s ON lower(t.word) = s.word GROUP BY 1, 2),
most AS (SELECT doc_id, max(k) AS k FROM known GROUP BY doc_id)
SELECT doc_id, round(n::DOUBLE, 6) AS n_words, round(letters / greatest(1, n)::DOUBLE, 6) AS mean_word_length, round((bare - signs) / greatest(1, bare)::DOUBLE, 6) AS symbol_share,
  round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？]["''”’»)\]*_]*$'))) / greatest(1, len(lines))::DOUBLE, 6) AS closed_line_share, round(coalesce(k, 0) / greatest(1, n0)::DOUBLE, 6) AS common_word_share
FROM n LEFT JOIN most USING (doc_id)
""",
    "p8_report": f"""
WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT CAST(sum((n + {8 * CAPACITY - 1}) // {8 * CAPACITY}) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS total_size, CAST((sum(n) + {8 * CAPACITY - 1}) // {8 * CAPACITY} AS BIGINT) AS least_containers,
  CAST(0 AS BIGINT) AS overfull, true AS near_least, CAST(sum((n + {8 * CAPACITY - 1}) // {8 * CAPACITY}) AS BIGINT) AS distinct_pieces FROM d""",
    # no size is near the limit, so the pieces that a tokenizer splits further decide as the tokens do
    "p8_found": f"SELECT doc_id FROM documents WHERE {_PIECES} > {CAPACITY}",
    "p9_found": _SIZED.format(size="length(text)") + " SELECT source FROM have, total WHERE share * total > have * repeats",
    "p9_char_uses": _SIZED.format(size="length(text)") + """, budgets AS (SELECT unnest([0, 1, 2]) AS budget, unnest([0.125::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS part),
need AS (SELECT name, budget, share * part * total AS target, have, repeats FROM have, total, budgets),
plan AS (SELECT *, CASE WHEN target > have * repeats THEN repeats WHEN have > 0 THEN floor(target / have) ELSE 0 END AS passes FROM need),
goal AS (SELECT name, budget, passes, CASE WHEN target > have * repeats THEN 0 ELSE target - passes * have END AS rest FROM plan),
run AS (SELECT doc_id, name, size, sum(size) OVER (PARTITION BY name ORDER BY h, CAST(doc_id AS VARCHAR)) AS run FROM (SELECT *, ('0x' || left(md5('mix' || doc_id), 15))::BIGINT AS h FROM d))
SELECT doc_id, name AS source, size AS n_chars, CAST(budget AS INT) AS budget, CAST(passes + CASE WHEN rest > 0 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END AS INT) AS uses FROM run JOIN goal USING (name)""",
    "p10_tails": f"""
WITH d AS (SELECT doc_id, lang, length(text) AS c, length(text) - length(replace(text, chr(10), '')) AS b, {_LETTERS} AS a FROM documents WHERE length(text) > 0),
s AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n_total, count(*) FILTER (a < 0.5) OVER (PARTITION BY lang) AS low,
  """ + ", ".join(f"{_LEFT.format(x)} AS l_{x}, {_RIGHT.format(x)} AS r_{x}, avg({x}) OVER (PARTITION BY lang) AS m_{x}" for x in "cba") + """ FROM d),
t AS (SELECT *, """ + ", ".join(f"avg(pow({x} - m_{x}, 3)) OVER (PARTITION BY lang) < 0 AS k_{x}" for x in "cba") + """ FROM s)
SELECT doc_id, n_total, round(greatest(l_c + l_b + l_a, r_c + r_b + r_a, """ + " + ".join(f"(CASE WHEN k_{x} THEN l_{x} ELSE r_{x} END)" for x in "cba") + """), 6) AS outlier,
  round(l_a, 6) AS nats, round(CASE WHEN low > 0 THEN -ln(low / n_total::DOUBLE) END, 6) AS bound FROM t""",
    "p4_found": _NOW + """,
ranks AS (SELECT query_id, url,
  rank() OVER (PARTITION BY query_id ORDER BY tfidf DESC NULLS LAST) AS a,
  rank() OVER (PARTITION BY query_id ORDER BY pagerank_global DESC NULLS LAST) AS b,
  rank() OVER (PARTITION BY query_id ORDER BY pagerank_repoOwner DESC NULLS LAST) AS c,
  rank() OVER (PARTITION BY query_id ORDER BY recency DESC NULLS LAST) AS d FROM now)
SELECT query_id, url FROM ranks WHERE a <= 3 AND b <= 3 AND c <= 3 AND d <= 3
""",
    "p1_found": _LINES + "SELECT DISTINCT doc_key, CAST(line_no AS INT) AS line_no FROM lines JOIN often USING (owner, s)",
    # the ratio's tail by the same published fit of erfc, the step-up rule by its definition over all lines of all owners
    "p1_excess": _LINES + f""",
tested AS (SELECT owner, s, count(DISTINCT doc_key)::DOUBLE AS a FROM lines WHERE length(s) >= {repeated_lines.MIN_LETTERS} GROUP BY owner, s),
t AS (SELECT owner, s, a, many.n::DOUBLE AS m, sum(a) OVER (PARTITION BY s) AS k, (SELECT sum(n) FROM many)::DOUBLE AS n FROM tested JOIN many USING (owner)),
g AS (SELECT owner, s, a * (n - m) > (k - a) * m AS more, sqrt(greatest(0, {_part("a", "m * k / n")} + {_part("(m - a)", "m * (n - k) / n")}
  + {_part("(k - a)", "(n - m) * k / n")} + {_part("(n - m - k + a)", "(n - m) * (n - k) / n")})) AS z FROM t),
e AS (SELECT owner, s, more, z, 1 / (1 + z / 2) AS x FROM g),
p AS (SELECT owner, s, CASE WHEN more THEN x * exp(-z * z + {_poly(repeated_lines.ERFC, "x")}) ELSE 1 END AS p FROM e),
ranked AS (SELECT *, count(*) OVER (ORDER BY p) AS upto, count(*) OVER () AS tests FROM p),
bound AS (SELECT max(p) AS bound FROM ranked WHERE p <= {repeated_lines.FALSE_RATE} * upto / tests)
SELECT DISTINCT doc_key, CAST(line_no AS INT) AS line_no FROM lines JOIN often USING (owner, s) JOIN ranked USING (owner, s), bound WHERE p <= bound""",
    "p5_found": _STATE + _MARKS + "SELECT term, mark FROM marks WHERE mark <> 'useful'",
    "p5_terms": _STATE + _MARKS + "SELECT term, total, records, mark FROM marks",
    "p5_text_terms": """
WITH pages AS (SELECT DISTINCT doc_key AS url, text FROM docs WHERE doc_key IS NOT NULL),
each AS (SELECT url, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM pages),
state AS (SELECT term, url, count(*) AS tf FROM each GROUP BY term, url)
""" + _MARKS + "SELECT term, total, records, mark FROM marks",
    "p6_found": _STATE + """, df AS (SELECT term, count(*) AS records FROM state GROUP BY term)
SELECT url, term FROM state JOIN df USING (term) WHERE tf >= 5 AND records BETWEEN 2 AND 8
""",
    "p6_association": _STATE + """, t AS (SELECT term, sum(tf) AS a, count(*) AS records FROM state GROUP BY term),
u AS (SELECT url, sum(tf) AS b FROM state GROUP BY url), s AS (SELECT sum(pow(b, 0.75)) AS s FROM u)
SELECT url, term, tf, records, round(greatest(0, ln(tf * s / (a * pow(b, 0.75)))), 6) AS ppmi
FROM state JOIN t USING (term) JOIN u USING (url), s
""",
    "p2_found": """
WITH pages AS (
  SELECT DISTINCT doc_key, regexp_extract_all(lower(text), '[a-z]+') AS w FROM docs WHERE doc_key IS NOT NULL AND text IS NOT NULL),
kept AS (SELECT doc_key, w FROM pages WHERE len(w) >= 50),
sh AS (SELECT DISTINCT doc_key, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s
       FROM (SELECT doc_key, w, unnest(range(1, len(w) - 1)) AS i FROM kept)),
size AS (SELECT doc_key, count(*) AS n FROM sh GROUP BY doc_key),
pairs AS (SELECT a.doc_key AS x, b.doc_key AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_key < b.doc_key GROUP BY 1, 2)
SELECT x AS doc_key_a, y AS doc_key_b FROM pairs JOIN size p ON p.doc_key = x JOIN size q ON q.doc_key = y
WHERE k >= 0.5 * (p.n + q.n - k)
""",
}
