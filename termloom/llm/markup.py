"""Markup left in texts: which kinds a text holds, and the text without them.

A text is converted rule by rule. Each rule is a construct of one kind and what stands for it in clean text; the
kinds of a text are those whose rules took something out of it, nothing else decides.

HTML pages of one host share their layout, so where their text stands is decided together. Every page's containers
are scored (characters outside links against those in links), and each page votes for or against the generalised path
of tags and classes of each of its containers. The votes are counted in Spark for each host and path, and a second
pass extracts the pages by the paths that won. A page's host here is its source (owner); ties win, so a host's only
page loses nothing but its link lists.

Headings, lists, code and formulas stay as text: a heading on a line of its own, items behind ``- ``,
code indented by four blanks, formulas without their delimiters.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.durable import durable, if_small

KINDS = ("html", "markdown", "wiki", "latex")
#: A page votes against a container if under this share of its text stands outside links.
MIN_TEXT_SHARE = 0.3

# fixed values: the element names of HTML
TAGS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output "
    "p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# fixed values: the behaviour switches of wiki pages
SWITCHES = "TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC INDEX NOINDEX STATICREDIRECT DISAMBIG".split()

_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(["script", "style", "template"])
_NAMES = "|".join(TAGS)
_TAG = re.compile(rf"</?(?:{_NAMES})(?=[\s/>])[^<>]*>", re.I)
_NO_TAG = re.compile(rf"<(?!/?(?:{_NAMES})(?=[\s/>])[^<>]*>)", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!--|<!doctype\b[^<>]*>?", re.I | re.S)
_COMMENT_START = re.compile(r"<!--|<!doctype\b[^<>]*>?", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot|copy|reg)(?![a-z0-9=;])", re.I)
_BLOCK_TAG = re.compile(r"<(?:" + "|".join(sorted(_BLOCK - {"hr"})) + r")(?=[\s>])", re.I)
_SILENT_TAG = re.compile(r"<(/?)(" + "|".join(sorted(_SILENT)) + r")(?=[\s/>])[^<>]*>", re.I)
_AND, _LESS = "\x02", "\x03"  # stand for & and < that the parser must leave alone


#: A path names at most so many of the innermost containers.
DEEPEST = 32


class _Page(HTMLParser):
    """Blocks of a page: [path, kind, text, linked characters]; ``used`` counts the tags read.

    Only blocks are kept open; of tags within lines it is counted how many links and silent elements are. A block that
    ends ends what was opened in it. All steps take the same time however many elements are open.
    """

    def __init__(self, loose: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.loose = loose  # text with a few stray tags: its line breaks are its layout
        self.stack: list[tuple[str, str, int, int, int]] = []  # tag, step of the path; links, silent and other elements open before it
        self.open: Counter[str] = Counter()
        self.links = self.silent = self.inline = 0
        self.blocks: list[list] = [["", "text", [], 0]]
        self.used = 0

    def _open(self, tag: str) -> None:
        kind = "head" if re.fullmatch("h[1-6]", tag) else "item" if tag in ("li", "dt", "dd") else "code" if tag == "pre" else "row" if tag == "tr" else "text"
        self.blocks.append([">".join(entry[1] for entry in self.stack[-DEEPEST:]), kind, [], 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in TAGS:
            return
        self.used += 1
        if tag in _VOID:
            if tag == "br":
                self.blocks[-1][2].append("\n")
            elif tag == "hr":
                self._open("hr")
            elif tag == "img":
                self.blocks[-1][2].append(dict(attrs).get("alt") or "")
            return
        if tag in _BLOCK:
            if tag == "p" and self.stack and self.stack[-1][0] == "p":
                self._close("p")  # a paragraph ends where the next begins
            name = dict(attrs).get("class") or ""
            # digits and the order of classes differ from page to page of one layout
            step = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(name.split()))
            self.stack.append((tag, step, self.links, self.silent, self.inline))
            self.open[tag] += 1
            self._open(tag)
        elif tag in ("td", "th") and self.blocks[-1][2]:
            self.blocks[-1][2].append("\t")
        if tag not in _BLOCK:
            self.open[tag] += 1
            self.inline += 1
        self.links += tag == "a"
        self.silent += tag in _SILENT

    def _close(self, tag: str) -> None:
        while self.stack:
            top, _, self.links, self.silent, self.inline = self.stack.pop()
            self.open[top] -= 1
            if top == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        self.used += 1
        if not self.open[tag]:
            return
        if tag in _BLOCK:
            self._close(tag)
            self._open("")
            return
        self.open[tag] -= 1
        self.inline = max(0, self.inline - 1)
        self.links = max(0, self.links - (tag == "a"))
        self.silent = max(0, self.silent - (tag in _SILENT))

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.blocks[-1][2].append(data if self.loose or not (self.stack or self.inline) or self.blocks[-1][1] == "code" else re.sub(r"[ \t]*\n[ \t]*", " ", data))
        if self.links:
            self.blocks[-1][3] += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        self.handle_data(data)

    def read(self, text: str) -> list[list]:
        self.feed(text)
        self.close()
        joined = [[path, kind, "".join(parts), linked] for path, kind, parts, linked in self.blocks]
        return [b for b in joined if b[2].strip()]


def _closed(text: str) -> str:
    """``text`` without the script, style and template tags that no closing tag answers: what follows them is text."""
    waiting: dict[str, list[re.Match]] = {name: [] for name in _SILENT}
    for m in _SILENT_TAG.finditer(text):
        if not m[1]:
            waiting[m[2].lower()].append(m)
        elif waiting[m[2].lower()]:
            waiting[m[2].lower()].pop()
    kept, start = [], 0
    for a, b in sorted(m.span() for ms in waiting.values() for m in ms):
        kept.append(text[start:a])
        start = b
    return "".join(kept) + text[start:]


def _indent(code: str) -> str:
    return "\n".join("    " + x if x.strip() else "" for x in code.strip("\n").split("\n"))


Rule = tuple[str, re.Pattern, str | Callable]


def _rules(*rules: tuple[str, str, str | Callable], flags: int = re.M) -> list[Rule]:
    """(a string without which the pattern can't match, pattern, what stands for a match)."""
    return [(guard, re.compile(pattern, flags), put) for guard, pattern, put in rules]


def _cells(row: str, between: str) -> str:
    return re.sub(rf"[ \t]*(?:{between})[ \t]*", "\t", row)


def _template(m: re.Match) -> str:
    """A template with one plain argument is that argument, any other one nothing."""
    return m[1].split("|")[-1].strip() if re.match(r"\w+\|[^|=\n]*$", m[1]) and not m[1].startswith(("toc", "stub")) else ""


_FENCED = re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n]*\n(.*?)^[ ]{0,3}\1[`~]*[ \t]*$\n?", re.M | re.S)
_FENCE = re.compile(r"^[ ]{0,3}(?:```+|~~~+)[^\n`~]*$\n?", re.M)
_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")

_MD_LINK = _rules(("](", r"!?\[([^\[\]\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1"))
_MARKDOWN = _rules(
    ("[^", r"^[ ]{0,3}\[\^[^\[\]\s]+\]:[ \t]*", ""),
    ("]:", r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S[^\n]*\n?", ""),
    ("[^", r"\[\^[^\[\]\s]+\]", ""),
    ("][", r"(?<![\w\]])\[([^\[\]\n]+)\]\[\w[^\[\]\n]*\]", r"\1"),
    ("#", r"^ {0,3}#{1,6}[ \t]+(\S[^\n]*?)[ \t]*#*(?:[ \t]*\{#[^{}\n]*\})?[ \t]*$", r"\1"),
    ("===", r"^([ ]{0,3}\S[^\n|]*\n) {0,3}={3,}[ \t]*$\n?", r"\1"),
    ("---", r"^([ ]{0,3}\S[^\n|]*\n) {0,3}-{3,}[ \t]*$\n?", r"\1"),
    (">", r"^[ ]{0,3}(?:>[ \t]?)+(?=\S)", ""),
    ("] ", r"^([ \t]*(?:[-*+]|\d+[.)])[ \t]+)\[[ xX]\][ \t]+(?=\S)", r"\1"),
    ("|", r"^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", ""),
    ("*", r"(?<![\w*\\])(\*{1,3})(?=[^\s*])((?:[^*\n]*[^\s*\\])?[^\s*\\])\1(?![\w*])", r"\2"),
    ("_", r"(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])", r"\1"),
    ("__", r"(?<![\w_\\])__(?=[^\s_])(?=[^_\n]*[ \t])([^_\n]*[^\s_])__(?![\w_])", r"\1"),
    ("~~", r"(?<![~\w])~~(?=[^\s~])((?:[^~\n]*[^\s~])?)~~(?![~\w])", r"\1"),
)
#: What else means markup once a text is known to be Markdown.
_MARKDOWN_THEN = _rules(
    (">", r"^[ ]{0,3}(?:>[ \t]?)+$", ""),
    ("|", r"^[ ]{0,3}\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", lambda m: _cells(m[1], r"\|")),
    ("*", r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*?)(?<=[^\s*])\1(?![\w*])", r"\2"),
)

_WIKI_TEMPLATE = _rules(("{{", r"\{\{([A-Za-z#:][^{}]*)\}\}", _template))
_WIKI = _rules(
    ("#R", r"^#REDIRECT\b\s*", ""),
    ("[[", r"\[\[(?=[^\[\]\n]*[A-Za-z])([^\[\]\n\d\s,'\"][^\[\]\n]*)\]\]", lambda m: "" if m[1].startswith("Category:") else m[1].split("|")[-1]),
    ("[http", r"\[https?://\S+[ \t]+([^\[\]\n]+)\]", r"\1"),
    ("==", r"^(={2,6})(?=[^=\n]*[^=\s])([^=\n]+)\1[ \t]*$", lambda m: m[2].strip()),
    ("''", r"(?<![\w'])'{2,3}(?=[^\s'])([^'\n]*(?:'[^'\n]+)*[^\s'])'{2,3}(?![\w'])|(?<![\w'])'{2,3}([^\s'])'{2,3}(?![\w'])", lambda m: m[1] or m[2]),
    ("|", r"^\{\|[^\n]*$\n?|^\|-[ \t]*$\n?|^\|\}[ \t]*(?:$\n?)?", ""),
    ("__", "__(?:" + "|".join(SWITCHES) + ")__", ""),
    ("<", r"</?(?:nowiki|ref)\b[^<>]*>", ""),
)
_WIKI_THEN = _rules(
    ("{{", r"\{\{([^{}]*)\}\}", _template),
    ("|", r"^[|!][ \t]*(?=[^|\n]*(?:\|\||!!))([^\n]*)$", lambda m: _cells(m[1], r"\|\||!!")),
    ("!!", r"^[|!][ \t]*(?=[^|\n]*(?:\|\||!!))([^\n]*)$", lambda m: _cells(m[1], r"\|\||!!")),
)

#: Formulas and code of LaTeX: their content (the first group that matched) is kept as it is.
_LATEX_KEPT = _rules(
    ("$$", r"\$\$([^$]+)\$\$", ""),
    ("\\[", r"^[ \t]*\\\[(.*?)\\\]", ""),
    ("\\(", r"(?<![\w\\])\\\((?=.)([^\n]*?)\\\)", ""),
    ("$", r"(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*(?:\\[A-Za-z]|[\^_=]))([^$\n]*[^\s$])\$(?![\w$])", ""),
    flags=re.M | re.S,
)
_LATEX_ARGUMENT = _rules(("\\", r"(?<![:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1"))
_LATEX = _rules(
    ("\\", r"^[^\n]*\\(?:newcommand|renewcommand|usepackage|documentclass)\b[^\n]*\n?", ""),
    ("\\begin", r"[ \t]*\\begin\{(?:tabular|array)\}(?:\{[^{}\n]*\})?\n?", ""),
    ("\\", r"[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?\n?", ""),
    ("\\item", r"^[ \t]*\\item(?![A-Za-z])(?:\[[^\]\n]*\])?[ \t]*", "- "),
    ("\\", r"~?\\(?:cite\w*|label|index|vspace|hspace|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", ""),
    ("\\footnote", r"\\footnote\{([^{}\n]*)\}", r" (\1)"),
)
_LATEX_REST = _rules(
    ("\\", r"(?<![\w:\\.\"'])\\(?:hline|centering|maketitle|noindent|par|newpage)(?=[\s{}\[\]()$,;.^_~&=]|$)[ \t]*", ""),
    ("\\", r"(?<![\w:\\.\"'])\\([A-Za-z]+)\*?(?=[\s{}\[\]()$,;.^_~&=]|$)(?!\\)", r"\1"),
    ("\\", r"(?<![:\\])\\[A-Za-z]+\*?\{", ""),
)
_LATEX_ROW = re.compile(r"^(?=[^\n]*(?<!\\)&)([^\n]*?)[ \t]*\\\\[ \t]*$", re.M)
_LATEX_MATH = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\*?\}[^\n]*\n(.*?)\\end\{\1\*?\}", re.S)
_EQUATION = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_WIKI_CODE = re.compile(r"\{\{code\|1=(.*?)\}\}", re.S)


class Reading:
    """One text on its way to clean text: ``found`` has the kinds whose rules took something, ``blocks`` the containers of its HTML."""

    def __init__(self, text: str) -> None:
        self.text = re.sub("[\x00\x02\x03]", "", text).replace("\r\n", "\n")
        self.held: list[str] = []
        self.found: set[str] = set()
        self.blocks: list[list] | None = None
        self._latex()
        self._markdown()
        self._wiki()
        self._html()

    def _keep(self, piece: str) -> str:
        self.held.append(piece)
        return f"\x00{len(self.held) - 1}\x00"

    def _take(self, kind: str, pattern: re.Pattern, put: str | Callable, guard: str = "") -> bool:
        if guard and guard not in self.text:
            return False
        self.text, n = pattern.subn(put, self.text)
        if n:
            self.found.add(kind)
        return n > 0

    def _all(self, kind: str, rules: list[Rule], again: bool = False) -> None:
        """Each rule once, or until it takes no more: every replacement is shorter, so that ends."""
        for guard, pattern, put in rules:
            while self._take(kind, pattern, put, guard) and again:
                pass

    def _latex(self) -> None:
        if "```" in self.text or "~~~" in self.text:
            self._take("markdown", _FENCED, lambda m: self._keep("\n" + _indent(m[2]) + "\n") + "\n")
        if "\\" in self.text or "$" in self.text:
            self._take("latex", _VERBATIM, lambda m: self._keep("\n" + _indent(m[2]) + "\n"), "\\begin")
            self._take("latex", _EQUATION, lambda m: self._keep(m[2].strip().replace("&", "").replace("\\\\", "")), "\\begin")
            for guard, pattern, _ in _LATEX_KEPT:
                self._take("latex", pattern, lambda m: self._keep(m[1].strip()), guard)
            self._all("latex", _LATEX)
            self._all("latex", _LATEX_ARGUMENT, again=True)
            self._all("latex", _LATEX_REST)
            if "latex" in self.found:
                self._take("latex", _LATEX_MATH, lambda m: self._keep((m[1] or m[2]).strip()))
                self._take("latex", _LATEX_ROW, lambda m: _cells(m[1], "&"))

    def _markdown(self) -> None:
        self._take("markdown", _CODE, lambda m: self._keep(m[1]), "`")
        if "```" in self.text or "~~~" in self.text:
            self._take("markdown", _FENCE, "")
        self._all("markdown", _MD_LINK, again=True)
        self._all("markdown", _MARKDOWN)
        if "markdown" in self.found:
            self._all("markdown", _MARKDOWN_THEN)

    def _wiki(self) -> None:
        self._take("wiki", _WIKI_CODE, lambda m: self._keep("\n" + _indent(m[1]) + "\n"), "{{code")
        self._all("wiki", _WIKI_TEMPLATE, again=True)
        self._all("wiki", _WIKI)
        if "wiki" in self.found:
            self._all("wiki", _WIKI_THEN[:1], again=True)
            self._all("wiki", _WIKI_THEN[1:])

    def _html(self) -> None:
        if "<!" in self.text:
            # behind the last end of a comment no comment is searched for its end
            closed, end, rest = self.text.rpartition("-->")
            self.text, n = _COMMENT.subn("", closed + end)
            rest, m = _COMMENT_START.subn("", rest)
            self.text += rest
            if n + m:
                self.found.add("html")
        if "<" in self.text and _TAG.search(self.text):
            text = _closed(self.text)
            page = _Page(len(_BLOCK_TAG.findall(text)) < 3)
            self.blocks = page.read(_NO_TAG.sub(_LESS, text).replace("&", _AND))
            if page.used or text != self.text:
                self.found.add("html")

    def scores(self) -> list[tuple[str, int, int]]:
        """(path, characters outside links, characters) of the page's containers."""
        sums: dict[str, list[int]] = {}
        for path, _, body, linked in self.blocks or ():
            size = len(body.strip())
            s = sums.setdefault(path, [0, 0])
            s[0] += max(0, size - linked)
            s[1] += size
        return [(p, a, b) for p, (a, b) in sums.items()]

    def clean(self, won: frozenset[str] | None = None) -> str:
        """The text by its winning paths, all if None; headings stay wherever they stand."""
        if self.blocks is not None:
            out = []
            for path, kind, body, _ in self.blocks:
                if won is not None and path and path not in won and kind != "head":
                    continue
                if kind == "code":
                    out.append("\n" + _indent(body) + "\n")
                elif kind == "item":
                    out.append("- " + body.strip())
                elif kind in ("head", "row"):
                    out.append(("\n" if kind == "head" else "") + body.strip() + ("\n" if kind == "head" else ""))
                else:
                    out.append(body.strip("\n") + "\n")
            self.text = "\n".join(out).replace(_LESS, "<").replace(_AND, "&")
        self._take("html", _ENTITY, lambda m: html.unescape(m[0]), "&")
        text = self.text
        while "\x00" in text:
            text = re.sub(r"\x00(\d+)\x00", lambda m: self.held[int(m[1])], text)
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def convert(text: str, won: frozenset[str] | None = None) -> tuple[list[str], str]:
    """(kinds of which a construct was taken out of ``text``, clean text). A text without markup is returned as it is."""
    reading = Reading(text)
    plain = reading.clean(won)
    kinds = [k for k in KINDS if k in reading.found]
    return kinds, plain if kinds else text


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path) of the generalised paths for which no fewer pages of the host vote than against. ``votes`` has page, host, path, own, size."""
    for_it = F.col("own") >= F.lit(MIN_TEXT_SHARE) * F.col("size")
    return votes.groupBy("host", "path").agg(F.sum(F.when(for_it, 1).otherwise(-1)).alias("n")).where("n >= 0").select("host", "path")


def page_winners(pages: DataFrame) -> DataFrame:
    """(page, won) of the pages that have containers on losing paths. ``pages`` has page, host and text.

    won holds the winning ones of the page's own paths, one a line, so no host's list has to fit anywhere. Pages all of
    whose paths win have no row. Equal texts of a host are one page with one vote.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows += [(i, h, p, a, b) for p, a, b in Reading(t.as_py()).scores() if p]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page", "host", "path", "own", "size"])

    likely = pages.where(F.col("text").rlike("<[A-Za-z/]"))
    votes = durable(likely.select("page", "host", "text").mapInArrow(score, "page string, host string, path string, own long, size long")).distinct()
    marked = votes.join(if_small(durable(winning_paths(votes).withColumn("wins", F.lit(True)))), ["host", "path"], "left")
    mine = marked.groupBy("page").agg(F.array_join(F.collect_set(F.when(F.col("wins"), F.col("path"))), "\n").alias("won"), F.count_if(F.col("wins").isNull()).alias("n_lost"))
    return mine.where("n_lost > 0").select("page", "won")


def clean_texts(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, kinds, text) for each row with a key: the kinds of markup taken out and the clean text.

    A null text stays null and has no kinds. Texts are read whole; repeated rows stay repeated. A null source is a host too.
    """
    host = F.coalesce(F.lower(F.trim(F.col(source))), F.lit(""))
    pages = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), host.alias("host"), F.col(text).alias("text"))
    pages = pages.withColumn("page", F.sha2(F.concat("host", F.lit("\n"), "text"), 256))
    # few pages have losing paths; only where they are many do the texts move to their lists
    joined = pages.join(if_small(durable(page_winners(pages))), "page", "left").select("key", "text", "won")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, out = [], []
            for t, paths in zip(batch.column(1), batch.column(2).to_pylist()):
                body = t.as_py()
                found, plain = convert(body, None if paths is None else frozenset(paths.split("\n"))) if body else ([], body)
                kinds.append(found)
                out.append(plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())], names=["key", "kinds", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(read, f"key {kind}, kinds array<string>, text string").withColumnsRenamed({"key": key, "text": text})
