"""Tokens, stop words, stems and term frequencies as column expressions.

Tokens are the runs of a-z of the lower-cased text that are no stop words, then stemmed; order and
repeats stay. Everything runs in the JVM. ``stem`` costs some twenty regular expressions, so tables
are stemmed on their distinct tokens (``stemmed``), never on every occurrence.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the commonest of the 1 210 stop words, most of them function words. A table of that length is a
#: parameter: a file of words, one a line, named by TERMLOOM_STOPWORDS or given to ``stop_words``; with it stop words,
#: terms and scores are those of the full list, without it the words not listed here are indexed as terms.
CORE_STOP_WORDS = (
    "about above across after again against all almost alone along already also although always am among an and another any anyone anything are around as at "
    "back be became because become been before behind being below between both but by can cannot come could did do does doing done down during "
    "each either else enough even ever every everyone everything few first for from full further get give go had has have having he hence her here hers herself him himself his how however "
    "html http i ie if in indeed into is it its itself just keep last least less made many may me might mine more most much must my myself "
    "neither never next no nobody none nor not nothing now nowhere of off often on once one only onto or other others our ours out over own "
    "part per perhaps please put quite rather really same see seem several she should since so some still such "
    "than that the their theirs them then there these they this those through thus to together too toward under until up upon us very "
    "was we well were what when where which while who whom whose why will with within without would yet you your yours"
).split()


def stop_words(path: str | None = None) -> list[str]:
    """Every single letter, the core list and, if named, the words of a file."""
    words = {chr(c) for c in range(ord("a"), ord("z") + 1)} | set(CORE_STOP_WORDS)
    path = path or os.environ.get("TERMLOOM_STOPWORDS")
    if path:
        with open(path, encoding="utf-8") as f:
            words |= {w for line in f for w in line.lower().split()}
    return sorted(words)


def is_stopword(token: Column, words: Iterable[str] | None = None) -> Column:
    return token.isin(list(words) if words is not None else stop_words())


def raw_tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text; an empty array for null."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ")
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def kept_tokens(text: Column, words: Iterable[str] | None = None) -> Column:
    """``raw_tokens`` without stop words, not yet stemmed."""
    stop = list(words) if words is not None else stop_words()
    return F.filter(raw_tokens(text), lambda x: ~x.isin(stop))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# A word is a sequence of consonant runs C and vowel runs V; y is always a consonant here.
_M_GT_0 = "^[^aeiou]*[aeiou]+[^aeiou]"
_M_EQ_1 = "^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]*$"
_M_GT_1 = "^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]+[^aeiou]"
_HAS_VOWEL = "^[^aeiou]*[aeiou]"
_CVC = "^[^aeiou]+[aeiou][^aeiouwxy]$"

# fixed values: suffixes and what stands for them
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _mapped(w: Column, table: dict[str, str]) -> Column:
    """The word with its longest listed suffix replaced, if what stands before it has a measure above 0."""
    pattern = f"^(.+?)({'|'.join(table)})$"
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return _let(F.regexp_extract(w, pattern, 1), lambda stem: F.when(stem.rlike(_M_GT_0), F.concat(stem, known[F.regexp_extract(w, pattern, 2)])).otherwise(w))


def _plural(w: Column) -> Column:
    return F.when(w.rlike("^.+(ss|i)es$"), F.left(w, F.length(w) - 2)).when(w.rlike("^.+[^s]s$"), F.left(w, F.length(w) - 1)).otherwise(w)


def _past(w: Column) -> Column:
    def after(s: Column) -> Column:
        doubled = s.rlike(r"([^aeiouylsz])\1$")
        return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(doubled, F.left(s, F.length(s) - 1)).when(s.rlike(_CVC), F.concat(s, F.lit("e"))).otherwise(s)

    eed = F.when(F.regexp_extract(w, "^(.+?)eed$", 1).rlike(_M_GT_0), F.left(w, F.length(w) - 1)).otherwise(w)
    cut = _let(F.regexp_extract(w, "^(.+?)(ed|ing)$", 1), lambda s: F.when(s.rlike(_HAS_VOWEL), after(s)).otherwise(w))
    return F.when(w.rlike("^.+eed$"), eed).otherwise(cut)


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("^.+y$") & F.left(w, F.length(w) - 1).rlike(_HAS_VOWEL), F.concat(F.left(w, F.length(w) - 1), F.lit("i"))).otherwise(w)


def _residual(w: Column) -> Column:
    pattern = f"^(.+?)({'|'.join(STEP_4)})$"
    plain = _let(F.regexp_extract(w, pattern, 1), lambda s: F.when(s.rlike(_M_GT_1), s).otherwise(w))
    ion = F.left(w, F.length(w) - 3)
    return F.when(w.rlike(pattern), plain).when(w.rlike("^.+(s|t)ion$") & ion.rlike(_M_GT_1), ion).otherwise(w)


def _final_e(w: Column) -> Column:
    return _let(F.regexp_extract(w, "^(.+?)e$", 1), lambda s: F.when(s.rlike(_M_GT_1) | (s.rlike(_M_EQ_1) & ~s.rlike(_CVC)), s).otherwise(w))


def _final_ll(w: Column) -> Column:
    return F.when(w.rlike("ll$") & w.rlike(_M_GT_1), F.left(w, F.length(w) - 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words under three letters and null stay as they are."""
    out = word
    for step in (_plural, _past, _final_y, lambda w: _mapped(w, STEP_2), lambda w: _mapped(w, STEP_3), _residual, _final_e, _final_ll):
        out = _let(out, step)
    return F.when(F.length(word) < 3, word).otherwise(out)


def stemmed(rows: DataFrame, token: str = "token", term: str = "term") -> DataFrame:
    """Adds the stem of a token column, computed once for each distinct token; joined by size as the run finds it."""
    vocabulary = rows.select(token).distinct().select(token, stem(F.col(token)).alias(term))
    return rows.join(vocabulary, token)


def tokenize(text: Column, words: Iterable[str] | None = None) -> Column:
    """Text to its array of terms; for single strings and small inputs, since it stems every occurrence."""
    return F.filter(F.transform(kept_tokens(text, words), stem), lambda x: x != "")


def query_terms(text: Column, words: Iterable[str] | None = None) -> Column:
    """Distinct terms in the order of their first occurrence."""
    return F.array_distinct(tokenize(text, words))


def term_counts(docs: DataFrame, key: str, text: str, words: Iterable[str] | None = None) -> DataFrame:
    """(key, term, tf), one row for each distinct term of each row's text; rows must have distinct keys.

    Occurrences are counted before stemming, so the join with the stems sees each (key, token) once.
    """
    tokens = docs.select(F.col(key), F.explode(kept_tokens(F.col(text), words)).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return stemmed(counted).where("term <> ''").groupBy(key, "term").agg(F.sum("n").alias("tf"))


def round4(x: Column) -> Column:
    """Four decimals, halves up towards plus infinity, on doubles."""
    return F.floor(x.cast("double") * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def ln_idf(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1)); below zero if a term occurs in more than n records."""
    return F.log((n.cast("double") + 1) / (df.cast("double") + 1))
