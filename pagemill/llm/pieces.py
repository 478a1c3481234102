"""Problem 5: pages above a size limit become numbered pieces, cut along the page's structure.

A page is read as a tree: sections under the sections they belong to (by the levels of headings, marked or tagged),
each with the text before its first subsection; in that text the page's blocks, then paragraphs, tables and lists, list
items under the items they belong to, sentences, words. Subtrees that fit are taken whole; only those that don't are
entered. Children of one section are merged with each other, from the bottom up, as far as the limit allows, and
never with those of another; below that, whatever is next to each other. Every piece but the first begins with the last
characters of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship

Span = tuple[int, int]

_HEADING = re.compile(r"(?P<hash>#{1,6})\s+\S|(?P<equal>={1,6})\s*\S|<h(?P<tag>[1-6])\b|(?P<name>chapter|part|section)\s+(?:\d+|[ivxlc]+)\b.{0,60}$", re.I)
_OPENING = re.compile(r"<(?:h[1-6]|p|div|section|table|tr|ul|ol|li|blockquote|pre)\b", re.I)
_LISTS = re.compile(r"<(/?)(?:ul|ol)\b", re.I)
_ROW = re.compile(r"\t|^\s*\||<tr\b| & .*\\\\\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•‣]|\(?\d{1,4}[.)]|\[[ xX]?\]|§ ?\d+|<li\b)", re.I)
_DISPLAY = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$|\[latex\].*?\[/latex\]|\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S | re.I)
_FORMULA = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$|\[latex\].*?\[/latex\]|\$[^$\s](?:[^$\n]*?[^$\s])?\$", re.S | re.I)
_SENTENCE = re.compile(r"(?<=[.!?;])[\"'”’»)\]]*\s+|(?<=[。！？；])")
_GAP = re.compile(r"\s+")
_LINE_END = re.compile(r"\r\n|\r|\n")


def _cuts(start: int, end: int, places: list[int]) -> list[Span]:
    """The spans between the places; together they are the whole span."""
    marks = [start, *sorted({p for p in places if start < p < end}), end]
    return list(zip(marks, marks[1:]))


def _merged(spans: list[Span], limit: int, first: int) -> list[Span]:
    """Neighbours joined from left to right up to the limit; a span at the text's beginning may take ``first``."""
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= (first if out[-1][0] == 0 else limit):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _outside(text: str, span: Span, pattern: re.Pattern, closed: re.Pattern) -> list[int]:
    """Ends of the pattern's matches in the span that are not inside a formula."""
    a, b = span
    held = [m.span() for m in closed.finditer(text, a, b)]
    out, k = [], 0
    for m in pattern.finditer(text, a, b):
        while k < len(held) and held[k][1] < m.end():
            k += 1
        if not (k < len(held) and held[k][0] < m.end() < held[k][1]):
            out.append(m.end())
    return out


def _lines(text: str, span: Span) -> list[Span]:
    """Lines, and what block-level tags open within them."""
    return _cuts(*span, [m.end() for m in _LINE_END.finditer(text, *span)] + [m.start() for m in _OPENING.finditer(text, *span)])


def _level(line: str) -> int:
    """1 to 6 for a heading, else 0."""
    m = _HEADING.match(line.strip())
    if not m:
        return 0
    named = {"section": 2}.get((m["name"] or "").lower(), 1)
    return len(m["hash"] or m["equal"] or "") or int(m["tag"] or 0) or named


@dataclass
class Section:
    """A stretch of the text under a heading (or the whole page): what comes before the first subsection, and these."""

    level: int
    start: int
    end: int
    body_end: int
    below: list["Section"] = field(default_factory=list)


def sections(text: str) -> Section:
    """The tree of a text's sections; a heading belongs to the nearest one before it of a lower level."""
    root = Section(0, 0, len(text), len(text))
    path = [root]
    for a, b in _lines(text, (0, len(text))):
        level = _level(text[a:b])
        if not level:
            continue
        while path[-1].level >= level:
            path.pop().end = a
        if not path[-1].below:
            path[-1].body_end = a
        here = Section(level, a, len(text), len(text))
        path[-1].below.append(here)
        path.append(here)
    for s in path:
        s.end = len(text)
    return _closed(root)


def _closed(section: Section) -> Section:
    """Bodies of sections without subsections end with them."""
    todo = [section]
    while todo:
        s = todo.pop()
        if not s.below:
            s.body_end = s.end
        todo += s.below
    return section


def _items(text: str, lines: list[Span]) -> list[Span]:
    """The outermost items or rows among the lines after the first, each with what is nested in it."""
    depth, places = 0, []
    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        if k and (_ROW.search(line) or _ITEM.match(line)):
            places.append((depth * 8 + len(line) - len(line.lstrip(" \t")), a))
        depth += sum(-1 if m[1] else 1 for m in _LISTS.finditer(line))
    outermost = min((d for d, _ in places), default=0)
    return _cuts(lines[0][0], lines[-1][1], [a for d, a in places if d == outermost]) if lines else []


def _blocks(text: str, lines: list[Span]) -> list[Span]:
    """Lines grouped into paragraphs, tables, lists; display formulas stay whole."""
    if not lines:
        return []
    start, end = lines[0][0], lines[-1][1]
    kinds = []
    for a, b in lines:
        line = text[a:b]
        kinds.append("" if not line.strip() else "row" if _ROW.search(line) else "item" if _ITEM.match(line) or _LISTS.match(line.lstrip()) else "text")
    places = []
    for i in range(1, len(lines)):
        if kinds[i - 1] != kinds[i] or kinds[i] == "text":
            places.append(lines[i][0])
    held = [m.span() for m in _DISPLAY.finditer(text, start, end)]
    return _cuts(start, end, [p for p in places if not any(a < p < b for a, b in held)])


def _pieces(text: str, section: Section, limit: int, first: int, blocks: list[int]) -> list[Span]:
    """The pieces of a section; those of an oversized subsection stay apart from its siblings."""
    out: list[Span] = []
    whole: list[Span] = []
    todo: list[Span | Section] = [(section.start, section.body_end), *section.below]
    for part in todo:
        a, b = part if isinstance(part, tuple) else (part.start, part.end)
        if a == b:
            continue
        if b - a <= (first if a == 0 else limit):
            whole.append((a, b))
            continue
        out += _merged(whole, limit, first)
        whole = []
        out += _pack(text, (a, b), limit, first, 0, blocks) if isinstance(part, tuple) else _pieces(text, part, limit, first, blocks)
    return out + _merged(whole, limit, first)


def _pack(text: str, span: Span, limit: int, first: int, depth: int, blocks: list[int]) -> list[Span]:
    """Spans of at most ``limit`` characters (``first`` at the beginning) that make up ``span``, a text without subsections."""
    a, b = span
    if b - a <= (first if a == 0 else limit):
        return [span]
    parts: list[Span] = [span]
    while depth < 5 and len(parts) == 1:
        depth += 1
        if depth == 1:  # the page's own blocks, where they are known
            parts = _cuts(a, b, blocks)
        elif depth == 2:
            parts = _blocks(text, _lines(text, span))
        elif depth == 3:  # rows and items, however deep they are nested; running text only if it has no sentences
            parts = _items(text, _lines(text, span))
        elif depth == 4:
            parts = _cuts(a, b, _outside(text, span, _SENTENCE, _FORMULA))
        else:
            parts = _cuts(a, b, _outside(text, span, _GAP, _FORMULA))
            if len(parts) == 1:
                parts = _cuts(a, b, [m.end() for m in _GAP.finditer(text, a, b)])
    if len(parts) == 1:  # nothing natural is left: plain slices
        marks, at = [], a + (first if a == 0 else limit)
        while at < b:
            marks.append(at)
            at += limit
        return _cuts(a, b, marks)
    again = depth - (depth == 3)  # an item may hold items
    return _merged([s for part in parts for s in _pack(text, part, limit, first, again, blocks)], limit, first)


def cut(text: str, max_chars: int, overlap: int, blocks: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, own, end) of each piece: text[start:end], of which text[start:own] is shared with the piece before.

    A text within the limit is one piece. ``blocks`` are places where blocks begin.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    spans = _pieces(text, sections(text), max_chars - overlap, max_chars, blocks or []) if text else []
    return [(max(0, a - overlap), a, b) for a, b in spans]


def block_target(block: Column) -> Column:
    """A paragraph's parts, joined by nothing; another block's target."""
    part = lambda p: F.coalesce(F.when(p["kind"] == "text", p["text"]).otherwise(p["target"]), p["text"], p["target"], F.lit(""))
    parts = F.array_join(F.transform(block["parts"], part), "")
    return F.when(F.coalesce(F.size(block["parts"]), F.lit(0)) > 0, parts).otherwise(block["target"])


def page_texts(pages: DataFrame, id_col: str = "id", doc_col: str = "doc_id", index_col: str = "page_index", text_col: str = "target_text", blocks_col: str = "blocks") -> DataFrame:
    """id, doc_id, page_index, text, targets: the text is the target or, if null or empty, the blocks' targets by lines."""
    targets = F.filter(F.transform(F.col(f"`{blocks_col}`"), block_target), lambda t: t.isNotNull() & (t != ""))
    own = F.col(f"`{text_col}`")
    text = F.when(own.isNotNull() & (own != ""), own).otherwise(F.coalesce(F.array_join(targets, "\n"), F.lit("")))
    return pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{doc_col}`").alias("doc_id"), F.col(f"`{index_col}`").alias("page_index"), text.alias("text"), targets.alias("targets")).where("id is not null")


_SCHEMA = "id string, doc_id string, page_index int, piece int, n_pieces int, start int, own_start int, end int, text string"


def oversized_pieces(texts: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """The pieces of the pages of ``page_texts`` that are longer than ``max_chars`` code points; one pass, no shuffle."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, doc, index, text, targets in zip(*(c.to_pylist() for c in batch.columns)):
                begins: list[int] = []
                if targets and "\n".join(targets) == text:
                    at = 0
                    for t in targets[:-1]:
                        at += len(t) + 1
                        begins.append(at)
                pieces = cut(text, max_chars, overlap, begins)
                out += [(page, doc, index, k, len(pieces), a, own, b, text[a:b]) for k, (a, own, b) in enumerate(pieces)]
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "doc_id", "page_index", "piece", "n_pieces", "start", "own_start", "end", "text"])

    long = texts.where(F.length("text") > max_chars).select("id", "doc_id", F.col("page_index").cast("int"), "text", "targets")
    return long.mapInArrow(run, _SCHEMA)


def page_pieces(pages: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """All pages as pieces, numbered from 0 in page order; a page within the limit is one piece.

    Null ids are left out, empty texts have one empty piece; repeated rows stay; an empty table gives an empty table.
    """
    texts = page_texts(pages)
    short = texts.where(F.length("text") <= max_chars)
    zero = F.lit(0)
    whole = short.select("id", "doc_id", F.col("page_index").cast("int").alias("page_index"), zero.alias("piece"), F.lit(1).alias("n_pieces"), zero.alias("start"), zero.alias("own_start"), F.length("text").alias("end"), "text")
    return oversized_pieces(texts, max_chars, overlap).unionByName(whole)
