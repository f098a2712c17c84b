"""Per-document text statistics, their ranks within a language, and whether a text is natural prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.durable import if_small
from termloom.llm.ranks import ROWS_A_PART, row_ranks

STATISTICS = ("n_words", "mean_word_length", "symbol_share", "closed_line_share", "common_word_share", "sentence_share")
#: A text at least half of whose non-blank characters stand in complete sentences is natural prose.
MIN_SENTENCES = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_MARKLESS = re.compile(r"[^\W_]+")
_CLOSERS = "\"'”’»)]*_"
_ENDS = ".!?…。！？"
# a piece ends behind end marks and closing quotes that blank space or the end follows; a full-width mark needs no blank
_PIECE = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*(?=\s|$)|(?<=[。！？])[\"'”’»）)\]]*")
# a line that stands for itself: bullets, numbers, table rows, quoted code, key-value pairs, indented text
_OWN_LINE = re.compile(r"^(?:\s{2,}|\t|\s*(?:[-*+•|>#={}\[\]<$/\\]|\d+[.)]\s|[\w.-]+\s*[:=]\s*[\d\"'{\[]))")
_REPEATS = 0.5


def _bare(text: str) -> int:
    """How many characters are not blank."""
    return sum(map(len, text.split()))


def _prose(piece: str, common: frozenset[str]) -> bool:
    """Whether a run that ends like a sentence reads like one."""
    words = _WORD.findall(piece)
    size = _bare(piece)
    if sum(map(len, words)) < 0.8 * size:
        return False
    if len(words) < 4 or size > 12 * len(words):
        han = _HAN.findall(piece)
        return len(han) >= max(5, 0.4 * size) and len(set(han)) >= 0.4 * len(han)
    words = [w.lower() for w in words]
    if len(set(words)) < _REPEATS * len(words):
        return False
    return sum(map(common.__contains__, words)) >= max(1, 0.05 * len(words)) or len(_HAN.findall(piece)) >= max(5, 0.4 * size)


def _longest_prose(lines: list[str], common: frozenset[str]) -> int | None:
    """The first line, from the second on, from which the lines to the end read like prose. Counts grow line by line from the end, so it is linear."""
    found, size, letters, n, known, han = None, 0, 0, 0, 0, 0
    words: set[str] = set()
    signs: set[str] = set()
    for k in range(len(lines) - 1, 0, -1):
        own, own_han = _WORD.findall(lines[k]), _HAN.findall(lines[k])
        size += _bare(lines[k])
        letters += sum(map(len, own))
        n += len(own)
        own = [w.lower() for w in own]
        known += sum(map(common.__contains__, own))
        words.update(own)
        han += len(own_han)
        signs.update(own_han)
        if letters < 0.8 * size:
            continue
        if n < 4 or size > 12 * n:
            good = han >= max(5, 0.4 * size) and len(signs) >= 0.4 * han
        else:
            good = len(words) >= _REPEATS * n and (known >= max(1, 0.05 * n) or han >= max(5, 0.4 * size))
        if good:
            found = k
    return found


def sentence_characters(text: str, common: frozenset[str]) -> int:
    """The non-blank characters of ``text`` that stand in complete sentences.

    Paragraphs are cut at blank lines, and lines that look like list items, table rows or code stand alone. What is
    left is joined over line breaks and cut behind end marks; a piece counts if it ends in one and reads like prose.
    """
    total = 0
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        run: list[str] = []
        parts: list[str] = []
        for line in block.split("\n"):
            if _OWN_LINE.match(line):
                parts += [" ".join(run), line] if run else [line]
                run = []
            else:
                run.append(line)
        if run:
            parts.append("\n".join(run))
        for part in parts:
            start = 0
            cuts = [m.end() for m in _PIECE.finditer(part)]
            for end in cuts:
                piece = part[start:end]
                start = end
                good = _prose(piece, common)
                if not good and "\n" in piece:
                    # headings above a sentence: the sentence may begin at a later line
                    lines = piece.split("\n")
                    k = _longest_prose(lines, common)
                    good, piece = k is not None, "\n".join(lines[k:])
                elif good and "\n" in piece:
                    piece = _without_headings(piece, common)
                if good:
                    total += _bare(piece)
    return total


def _without_headings(piece: str, common: frozenset[str]) -> str:
    """Drops leading lines that are shorter than a wrapped line would be: menu entries and headings."""
    lines = piece.strip("\n").split("\n")
    width = max(map(len, lines))
    k = 0
    while k < len(lines) - 1 and len(lines[k]) + 1 + len(lines[k + 1].split(" ", 1)[0]) < 0.6 * width and len(lines[k].split()) <= 3 and lines[k + 1][:1].isupper():
        k += 1
    return "\n".join(lines[k:])


def describe(text: str, common_by_lang: dict[str, frozenset[str]], common: frozenset[str]) -> tuple[float, ...]:
    bare = max(1, _bare(text))
    words = [w.lower() for w in _WORD.findall(text)]
    letters = sum(map(len, words))
    n = len(words)
    if letters > 12 * n:  # words without blanks between them
        han = _HAN.findall(text)
        n += len(han) - sum(1 for w in words if _HAN.match(w))
    symbols = bare - sum(map(len, _MARKLESS.findall(text)))
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    closed = sum(x.rstrip(_CLOSERS)[-1:] in _ENDS and x.rstrip(_CLOSERS) != "" for x in lines)
    known = [w for w in words if w in common]
    share = max((sum(map(c.__contains__, known)) for c in common_by_lang.values()), default=0) / max(1, len(words))
    return n, letters / max(1, n), symbols / bare, closed / max(1, len(lines)), share, sentence_characters(text, common) / bare


def language_key(lang: Column) -> Column:
    """The first two letters, lower-cased; 'und' where there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(lang), r"^\s*([a-z]{2})(?:[^a-z]|$)", 1), F.lit("")), F.lit("und"))


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, statistics) for each row with non-blank text. A row of Python work for each batch, whole texts.

    ``common_words`` (lang, word) is a short fixed list, held by every worker. A Han character counts as a word.
    """
    by_lang: dict[str, set[str]] = {}
    for row in common_words.where("word IS NOT NULL").select("lang", "word").collect():
        by_lang.setdefault(row[0], set()).add(row[1].lower())
    frozen = {k: frozenset(v) for k, v in by_lang.items()}
    common = frozenset().union(*frozen.values())
    rows = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key), language_key(F.col(lang)).alias("language"), F.col(text).alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [describe(t.as_py(), frozen, common) for t in batch.column(2)]
            columns = [pa.array([float(v[k]) for v in values], pa.float64()) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[batch.schema.names[0], "language", *STATISTICS])

    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, language string, " + ", ".join(f"{s} double" for s in STATISTICS)
    return rows.mapInArrow(measure, kinds)


def tail_scores(rows: DataFrame, key: str, group: str, statistics: tuple[str, ...], cut: tuple[str, float]) -> DataFrame:
    """Adds n_total, outlier, nats and bound to ``rows``, whose keys are distinct and which are read several times.

    For each statistic the empirical-cumulative tail probabilities of the row's value within its group are the shares
    of the group's rows at or below it (left) and at or above it (right); equal values share them. The outlier score is
    the greatest of three sums of -ln over the statistics: all left tails, all right tails, and for each statistic the
    tail on the longer side of its distribution (by its skewness). A null statistic ranks below all values.

    ``cut`` names a statistic and a limit, and nats is that statistic's left term of the sums. bound is -ln of the share
    of the group's rows under the limit, null where there are none. nats reaches bound for just these rows, by their
    ranks, however many of them are equal; and as no term of a sum is negative, none of them has an outlier score under it.
    """
    n, (cut_by, limit) = len(statistics), cut
    stats = rows.select(F.col(key).alias("_id"), F.col(group).alias("_g"), *[(F.col(s).cast("double") + F.lit(0.0)).alias(f"_s{i}") for i, s in enumerate(statistics)])
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), stats.count() * n // ROWS_A_PART)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"_s{i}").alias("v")) for i in range(n)]))
    ranked = row_ranks(stats.select("_id", "_g", each.alias("e")).select("_id", "_g", "e.k", "e.v"), ["_g", "k"], ["v"], parts)
    left = -F.log((F.col("n_less") + F.col("n_equal")) / F.col("n_total"))
    right = -F.log((F.col("n_total") - F.col("n_less")) / F.col("n_total"))
    at = lambda i, x: F.max(F.when(F.col("k") == i, x))
    tails = ranked.groupBy("_id", "_g").agg(F.max("n_total").alias("n_total"), F.array(*[at(i, left) for i in range(n)]).alias("left"), F.array(*[at(i, right) for i in range(n)]).alias("right"))
    skews = [F.coalesce(F.skewness(f"_s{i}"), F.lit(0.0)) < 0 for i in range(n)]
    low = F.coalesce(F.col(f"_s{statistics.index(cut_by)}"), F.lit(float("-inf"))) < limit
    groups = stats.groupBy("_g").agg(F.array(*skews).alias("to_left"), F.count_if(low).alias("n_low"), F.count(F.lit(1)).alias("n"))
    scored = tails.alias("x").join(if_small(groups).alias("y"), F.col("x._g").eqNullSafe(F.col("y._g")))
    longer = F.transform(F.arrays_zip("left", "right", "to_left"), lambda t: F.when(t["to_left"], t["left"]).otherwise(t["right"]))
    outlier = F.greatest(*[F.aggregate(side, F.lit(0.0), lambda a, x: a + x) for side in (F.col("left"), F.col("right"), longer)])
    bound = F.when(F.col("n_low") > 0, -F.log(F.col("n_low") / F.col("n")))
    nats = F.element_at("left", statistics.index(cut_by) + 1)
    return rows.join(scored.select(F.col("_id").alias(key), "n_total", outlier.alias("outlier"), nats.alias("nats"), bound.alias("bound")), key)


def quality(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds n_total, outlier, nats, bound and natural to ``text_statistics``; see ``tail_scores``, by language.

    A text is not natural if its sentence share lies in that tail of its language's distribution which the texts with too
    few sentences make up. The outlier score says how unusual a text is for its language in all statistics together.
    """
    scored = tail_scores(stats, key, "language", STATISTICS, ("sentence_share", MIN_SENTENCES))
    return scored.withColumn("natural", ~F.coalesce(F.col("nats") >= F.col("bound"), F.lit(False)))
