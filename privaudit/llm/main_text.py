"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of text runs and tags.  A run scores one point a word,
a tag costs points, and one linear scan finds the contiguous part with the
highest sum: the content region.  Within it, elements whose own part of the
sequence scores below zero are left out: their words count against them, since
their name, or a whole token of their class, id or role, marks them as no part
of an article.  In the scan such an element costs ``gap`` points outside
``article`` and ``main`` and nothing inside, so an advert in the middle does not
cut an article in two, while a few words beyond a menu do not join it.

Weights come from labelled pages: pages with exactly one ``article`` or ``main``
element, whose inside is the content.

* A tag costs in proportion to the logarithm of how much more often it stands
  outside than inside, from 0.1 to 1 points, and 0.1 points inside ``article`` and
  ``main``.  The proportion and the gap are those with the best word-level F1 over
  the labelled pages, scanned as if their content were not known; of equally good
  ones the middle.
* A token is a mark if it stands on ``exp(_MARK)`` times as many elements outside as
  on elements inside or around the content.  Elements within outer ones are not
  counted: the outer one explains them.  To the learnt marks come ``_NAMED``,
  elements that HTML defines as no running text, and ``marks``, tokens that say what
  the caller never wants.

Tokens mark neither headings nor inline elements, nor what holds an ``article`` or
``main``, nor, where a page has none, what holds most of its words.  About
``sample_pages`` labelled pages are used, those with the smallest hashes of
``page_id`` (a documented bound); the weights apply to every page.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space in page order.

Defined cases: null and empty pages have an empty text; a page without words has
an empty text; among regions of equal score the earlier and shorter one wins;
``script`` and ``style`` end at their closing tag only (unclosed, with the page);
other elements that hold no running text and are never closed end at once;
further unclosed elements end with their parent; an unclosed comment ends with the
page; repeated rows give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.storage import about

#: Name and attributes of a tag; possessive, so that a failure costs one pass.  A quote opens a value only after "=".
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose inside is no markup.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "title", "textarea", "iframe", "xmp", "noframes")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTENT = ("article", "main")
#: Elements that HTML defines as navigation, page furniture, controls or fallback.
_NAMED = {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "select", "textarea", "title", "iframe", "noscript", "template", "object", "canvas", "svg", "script", "style", "xmp", "noframes"}
_CLOSED_ONLY = {"select", "noscript", "template", "object", "canvas", "svg", "button"}
MARKS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "cookies", "footer", "menu", "navbar", "navigation", "newsletter", "notice", "promo", "replies", "sidebar", "sponsored", "subscribe")
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_MARK, _LEAST, _MOST = 2.0, 0.1, 1.0
_SCALES, _GAPS = (0.25, 0.5, 1.0), (4.0, 8.0, 16.0)


class Page:
    """The token sequence of a page, and its elements."""

    def __init__(self, source: str):
        self.tags: list[str | None] = []  # a tag's name ("/name" when closing), or None for a text run
        self.texts: list[str] = []
        self.words: list[int] = []
        self.content: list[bool] = []
        self.contents = 0
        #: name, class, id and role tokens, first token, token after the last, parent, closed by a tag, inside content
        self.elements: list[list] = []
        self._stack: list[int] = []
        self._open_names: list[Counter] = [Counter()]
        self._open_pages: Counter = Counter()  # html and body, wherever they are
        self._depth = 0  # content elements around
        self._read(source)
        for e in self._stack:
            self.elements[e][3] = len(self.tags)
        self._stack = []

    def _read(self, source: str) -> None:
        at, n, text, lost = 0, len(source), 0, set()
        while True:
            at = source.find("<", at)
            if at < 0:
                break
            after = source[at + 1 : at + 2]
            if source.startswith("<!--", at):
                self._text(source[text:at])
                end = source.find("-->", at + 4)
                at = text = end + 3 if end >= 0 else n
                continue
            if after not in ("/", "!", "?") and not (after.isascii() and after.isalpha()):
                at += 1
                continue
            if source.find(">", at) < 0:  # no tag ends any more
                break
            found = _TAG.match(source, at) or _PLAIN_TAG.match(source, at)
            self._text(source[text:at])
            if not found:  # a declaration, or a closing tag without a name
                at = text = source.index(">", at) + 1
                continue
            at = text = found.end()
            closing, name, attributes = found.group(1), found.group(2).lower(), found.group(3)
            if closing:
                self._close(name)
            elif name in _RAW:
                end = None if name in lost else _RAW[name].search(source, at)
                if end is None:
                    lost.add(name)
                if end or name in ("script", "style"):
                    at = text = end.end() if end else n
                self._tag(name)
            else:
                self._open(name, attributes)
        self._text(source[text:])

    def _add(self, tag: str | None, text: str, words: int) -> None:
        self.tags.append(tag)
        self.texts.append(text)
        self.words.append(words)
        self.content.append(self._depth > 0)

    def _text(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self._add(None, text, len(text.split()))

    def _tag(self, name: str) -> None:
        self._add(name, "", 0)

    def _open(self, name: str, attributes: str) -> None:
        if name in _CLOSES_P and any(self.elements[e][0] == "p" for e in self._stack[-3:]):
            self._close("p", silent=True)
        tokens: set[str] = set()
        if attributes and name not in ("html", "body"):
            for m in _NAMES.finditer(attributes):
                tokens.update((m.group(1) or m.group(2) or m.group(3) or "").lower().split())
        parent = self._stack[-1] if self._stack else -1
        self._tag(name)
        if name in _VOID:
            return
        if name == "header" and self._depth:
            name = "header of content"
        self.elements.append([name, tokens, len(self.tags) - 1, len(self.tags), parent, False, self._depth > 0])
        if name in _CONTENT:
            self.contents += not self._depth
            self._depth += 1
            self._open_names.append(Counter())
        self._stack.append(len(self.elements) - 1)
        self._open_names[-1][name] += 1
        if name in ("html", "body"):
            self._open_pages[name] += 1

    def _close(self, name: str, silent: bool = False) -> None:
        if name == "header" and self._depth and not self._open_names[-1]["header"]:
            name = "header of content"
        if name in ("html", "body"):
            known = self._open_pages[name] > 0
        else:  # a stray closing tag does not end the content around it
            known = self._open_names[-1][name] > 0
        while known:
            e = self.elements[self._stack.pop()]
            self._open_names[-1][e[0]] -= 1
            if e[0] in ("html", "body"):
                self._open_pages[e[0]] -= 1
            if e[0] in _CONTENT:
                self._open_names.pop()
                self._depth -= 1
            e[3] = len(self.tags) + (e[0] == name and not silent)
            if e[0] == name:
                e[5] = not silent
                break
        if not silent:
            self._tag("/" + name.partition(" ")[0])

    def _real(self, e: list) -> bool:
        """An element that must be closed to be one."""
        return e[5] or e[0] not in _CLOSED_ONLY

    def _holders(self) -> set[int]:
        """Elements around an article or main element."""
        around: set[int] = set()
        for k, e in enumerate(self.elements):
            if e[0] in _CONTENT:
                while k >= 0 and k not in around:
                    around.add(k)
                    k = self.elements[k][4]
        return around

    def marked(self, marks: set[str]) -> list[list]:
        """The outermost elements whose part scores below zero: those with a mark (names, and ".token")."""
        around, out, until = self._holders(), [], 0
        totals = [0]
        for n in self.words:
            totals.append(totals[-1] + n)
        for k, e in enumerate(self.elements):
            name, tokens, first, stop = e[:4]
            if first < until or k in around or not self._real(e):
                continue
            hit = name in marks
            if not hit and name not in _HEADINGS and name not in _INLINE:
                hit = any("." + t in marks for t in tokens) and (self.contents > 0 or 2 * (totals[stop] - totals[first]) <= totals[-1])
            if hit:
                out.append(e)
                until = stop
        return out

    def evidence(self) -> Iterator[tuple[str, bool]]:
        """Marks seen, and whether outside, of the elements that no outer element explains."""
        around, until = self._holders(), 0
        for k, e in enumerate(self.elements):
            if e[2] < until:
                continue
            outside = k not in around and not e[6]
            if outside:
                until = e[3]
            if e[0] in _CONTENT:
                continue
            for token in e[1]:
                yield f".{token}", outside

    def region(self, costs: dict[str, float], other: float, out: list[list], gap: float, known: bool = True) -> tuple[int, int]:
        """[start, end) of the maximum-scoring contiguous part, by one scan; ``out``: elements that are left out.

        ``known``: the page's own ``article`` or ``main`` lowers the costs inside.
        """
        best, span, score, start = 0.0, (0, 0), 0.0, 0
        at, left = 0, iter(out)
        e = next(left, None)
        while at < len(self.tags):
            if score <= 0:
                score, start = 0.0, at
            if e is not None and at == e[2]:
                score -= 0.0 if known and e[6] else gap
                at, e = e[3], next(left, None)
                continue
            tag = self.tags[at]
            score += float(self.words[at]) if tag is None else -_LEAST if known and self.content[at] else -costs.get(tag, other)
            at += 1
            if score > best:
                best, span = score, (start, at)
        return span

    def text(self, span: tuple[int, int], out: list[list]) -> str:
        dropped = bytearray(len(self.tags))
        for e in out:
            dropped[e[2] : e[3]] = b"\x01" * (e[3] - e[2])
        blocks, run = [], []
        for i in range(*span):
            tag = self.tags[i]
            if tag is None:
                if not dropped[i]:
                    run.append(self.texts[i])
            elif tag.lstrip("/") not in _INLINE and run:
                blocks.append(" ".join("".join(run).split()))
                run = []
        blocks.append(" ".join("".join(run).split()))
        return " ".join(b for b in blocks if b)

    def agreement(self, span: tuple[int, int], out: list[list]) -> tuple[int, int, int]:
        """Words in both the region and the labelled content, in the region, in the content; left-out elements aside."""
        both = mine = true = at = 0
        for e in [*out, None]:
            stop = e[2] if e else len(self.tags)
            for i in range(at, stop):
                n = self.words[i]
                if n:
                    chosen, inside = span[0] <= i < span[1], self.content[i]
                    both, mine, true = both + n * (chosen and inside), mine + n * chosen, true + n * inside
            at = e[3] if e else stop
        return both, mine, true


class Weights:
    """Costs of tags, cost of other tags, gap and marks, from labelled pages."""

    def __init__(self, pages: list[str], marks: tuple[str, ...] = MARKS):
        parsed = [p for p in map(Page, pages) if p.contents == 1]
        inside, outside = Counter({"a": 1, "/a": 1}), Counter({"a": 9, "/a": 9})  # links are mostly not running text
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for p in parsed:
            for tag, content in zip(p.tags, p.content):
                if tag is not None and tag.lstrip("/") not in _CONTENT:
                    (inside if content else outside)[tag] += 1
            for mark, out in p.evidence():
                seen[out][mark] += 1
        learnt = {m for m, n in seen[True].items() if math.log((n + 1) / (seen[False][m] + 1)) >= _MARK}
        self.marks = learnt | _NAMED | {f".{m}" for m in marks}
        logs = {t: math.log((outside[t] + 1) / (inside[t] + 1)) for t in {*inside, *outside}}
        left = [p.marked(self.marks) for p in parsed]
        found: dict[tuple[float, float], float] = {}
        for scale in _SCALES:
            costs = {t: min(_MOST, max(_LEAST, scale * v)) for t, v in logs.items()}
            for gap in _GAPS:
                f1 = [2 * b / max(1, m + t) for b, m, t in (p.agreement(p.region(costs, _LEAST, out, gap, known=False), out) for p, out in zip(parsed, left))]
                found[scale, gap] = sum(f1) / max(1, len(f1))
        good = [k for k, v in found.items() if v >= max(found.values()) - 1e-9]
        scale, self.gap = good[len(good) // 2]
        self.costs, self.other = {t: min(_MOST, max(_LEAST, scale * v)) for t, v in logs.items()}, _LEAST

    def text(self, source: str) -> str:
        page = Page(source)
        out = page.marked(self.marks)
        return page.text(page.region(self.costs, self.other, out, self.gap), out)


def extract(pages: DataFrame, sample_pages: int = 400, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """``page_id, url, text`` for every row of ``page_id, url, html``."""
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    labelled = pages.select("page_id", "html").where("html is not null and (lower(html) like '%<article%' or lower(html) like '%<main%')")
    chosen = about(labelled.select("page_id", "html"), sample_pages, "page_id").limit(2 * sample_pages)
    weights = Weights(sorted(r["html"] for r in chosen.collect()), marks)  # about sample_pages rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [weights.text(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), source.alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
