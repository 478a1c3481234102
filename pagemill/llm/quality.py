"""Problem 9: text statistics of each document, and what they tell: running text, list, table or junk.

All statistics of a document come from one pass over its whole text. Besides words, symbols, line ends and common
words there are repetition statistics: the shares of repeated lines and paragraphs, and the share of the characters
that the most frequent word pair, triple and quadruple cover. Every line is then read as a sentence, list entry,
table row or junk by combined rules, and the kind that holds most of the characters is the document's; what would
be running text is junk when its lines, paragraphs or runs of words are the same few over and over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship

#: Frequent function words of the corpus' languages.
COMMON = frozenset(
    "the of and to a in is that it for on with as by this are be an at or from each one some no if while after which who what"
    " der die das und ist im ein eine mit von auf nicht dem weil auch durch oder aber zu"
    " le la les une un et est dans pour sur par pas que ou mais car de du chez"
    " el los y en por para con no como más pues pero sin se es".split()
)
_WORD = re.compile(r"[^\W_]+")
_ZH = re.compile(r"[㐀-鿿]")
_BREAK = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]+")
_PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SPACE = re.compile(r"\s+")
_FORMULA = re.compile(r"^(?:\\\[.*\\\]|\$\$.*\$\$|\[latex\].*\[/latex\]|\\begin\{(\w+\*?)\}.*\\end\{\1\})$", re.S)
_INLINE = re.compile(r"\\\(.*?\\\)|\$[^$\s](?:[^$\n]*?[^$\s])?\$|\\\[.*?\\\]")
_ENDS = frozenset(".!?。！？;；:：…")
_CLOSERS = "\"'”’»)]"
_STOP = re.compile(r"[.!?。！？;；,，、:]")
_ENTRY = re.compile(r"^(?:[-*+•‣◦▪·–—]|\[(?:[ xX]?|\d{1,4})\]|[☐☑☒]|\(?\d{1,4}[.)]|§ ?\d+|\(?[a-z]\)|[ivxlc]{1,6}[.)]|#\d+)\s*\S", re.I)
_LEADER = re.compile(r"(?:\.{3,}|(?: \.){3,}|…{2,})\s*\d*$")
_PAIR = re.compile(r"^[^\W\d_][\w \-]{0,40}: ?\S.{0,60}$")
_ROW = re.compile(r"</?(?:td|tr|th|table|thead|tbody)\b", re.I)
_CELLS = re.compile(r"\s*\|\s*")
_GAP = re.compile(r"\s{2,}")
_HEX = re.compile(r"^(?:[0-9a-f]{6,16}[: ]\s*)?(?:[0-9a-f]{2}\s+){6,}[0-9a-f]{2}\b", re.I)
_LONG = re.compile(r"\S{40,}")
_VOWEL = re.compile(r"[aeiouyäöüàâáéèêëíìîïóòôúùûœæ]", re.I)
_CITED = re.compile(r"^\[\d{1,4}\] ")
_MANGLED = re.compile("\ufffd|ï¿½|Ã[\u0080-\u00bf]|Â|â€.?")  # text decoded by the wrong rule
_PLAIN_END = frozenset(".!?。！？")
_SUSPECT = re.compile(r"[|\t&<\\\ufffd]|^[-*+•§\[(#\d]|\.\.\.|\S{40}")

def ended(line: str) -> bool:
    """Whether a line ends in punctuation, quotes and brackets after it apart."""
    return line.rstrip(_CLOSERS)[-1:] in _ENDS if line else False


def top_share(codes: np.ndarray, lengths: np.ndarray, size: int, letters: int) -> tuple[float, int]:
    """(share of the letters, times) of the most frequent code of a run of ``size`` words, the first one of equals."""
    ordered = np.sort(codes)
    begins = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    times = np.diff(begins, append=len(codes))
    most = int(times.max())
    if most == 1:
        return 0.0, 1
    equals = ordered[begins[times == most]]
    at = int(np.argmax(codes == equals[0] if len(equals) == 1 else np.isin(codes, equals)))
    return min(1.0, most * int(lengths[at : at + size].sum()) / max(letters, 1)), most


KINDS = ("text", "list", "table", "junk")


def line_kind(line: str, short_words: int = 6) -> str | None:
    """What one line looks like: text, list, table, junk, None for a formula that stands alone or nothing at all,
    or short: an entry without a mark, or part of a hard-wrapped sentence."""
    if len(line) >= 60 and line[-1] in _PLAIN_END and not _SUSPECT.search(line) and line.count(" ") >= len(line) // 16:
        return "text"
    if line[0] in "\\$[" and _FORMULA.match(line):
        return None
    if "<" in line and _ROW.search(line):
        return "table"
    bare = _SPACE.sub(" ", _TAG.sub(" ", line) if "<" in line else line).strip()
    if not bare:
        return None
    if line[:3].lower() == "<li":
        return "list"
    body = _INLINE.sub(" ", bare) if "\\" in bare or "$" in bare else bare
    solid = len(body) - body.count(" ")
    if not solid:
        return None
    words = _WORD.findall(body)
    alnum = sum(map(len, words))
    leads = ("..." in bare or " . ." in bare or "……" in bare) and _LEADER.search(bare)
    if line.count("|") >= 2 and line.lstrip().startswith("|") and (alnum or re.match(r"^[|:\-\s]+$", line)):
        cells = [c for c in _CELLS.split(line.strip().strip("|")) if c]
        if any(any(map(str.isalnum, c)) for c in cells) or "-" in line:
            return "table"
    if _HEX.match(bare):
        return "junk"
    if alnum < 0.45 * solid and not leads:
        return "junk"
    chinese = 0 if body.isascii() else len(_ZH.findall(body))
    if not chinese and len(body) >= 40 and _LONG.search(body) and sum(len(x) for x in _LONG.findall(body)) > 0.6 * len(body) and not re.search(r"https?:", body):
        cells = body.split(",")
        if not (len(cells) >= 3 and max(map(len, cells)) <= 25):
            return "junk"
    if "\t" in line.strip():
        cells = [c for c in line.strip().split("\t") if c.strip()]
        if len(cells) >= 2 and max(len(c.split()) for c in cells) <= 5:
            return "table"
    if " & " in line and (line.rstrip().endswith("\\\\") or line.count(" & ") >= 2):
        return "table"
    if line.count(";") >= 2 and re.match(r"^[^;\s]*(?:;[^;\s]*)+$", line.strip()):
        return "table"
    if "," in line and re.match(r"^[^,\s]+(?:,[^,\s]+)+$", line.strip()) and not chinese:
        return "table"
    cells = _CELLS.split(bare) if "|" in bare else []
    if len(cells) >= 3 and max(len(c.split()) for c in cells) <= 4:
        folded = Counter(c.lower() for c in cells)
        return "junk" if len(cells) >= 8 and len(folded) < 0.6 * len(cells) else "table"
    cells = _GAP.split(line.strip()) if "  " in line else []
    if len(cells) >= 2 and max(len(c.split()) for c in cells) <= 2 and len(max(_GAP.findall(line.strip()), key=len, default="")) >= 3:
        return "table"
    if len(cells) >= 3 and max(len(c.split()) for c in cells) <= 1 and not ended(bare):
        return "table"
    if leads:
        return "list"
    closed = ended(bare)
    if bare[0] == "[" and _CITED.match(bare) and len(words) <= 24:
        return "list"
    if _ENTRY.match(bare) and len(words) <= 14 and not (closed and len(words) > 8):
        return "list"
    if ":" in bare and len(words) <= 7 and _PAIR.match(bare) and not re.search(r"[.!?]$", bare):
        return "list"
    if chinese:
        return "text"
    if len(words) <= short_words and not closed and not _STOP.search(body):
        return "short"
    return "text"


def describe(text: str | None) -> dict:
    """The statistics of one text; null, empty and blank texts have zeros and no kind."""
    out = dict.fromkeys(NUMBERS, 0.0) | {"n_chars": len(text or ""), "n_words": 0, "n_lines": 0, "kind": None}
    if not text or text.isspace():
        return out
    words = _WORD.findall(text.lower())
    lines = [x for x in map(str.strip, _BREAK.split(text)) if x]
    often = 0  # times of the most frequent run of four words
    n_solid, n_words = sum(map(len, text.split())), len(words)
    chinese = 0 if text.isascii() else len(_ZH.findall(text))
    out["n_words"], out["n_lines"] = n_words, len(lines)
    letters = sum(map(len, words))
    out["symbol_ratio"] = 1 - letters / n_solid if n_solid else 0.0
    if lines:
        out["line_end_share"] = sum(map(ended, lines)) / len(lines)
        counts = Counter(lines)
        out["dup_line_share"] = 1 - len(counts) / len(lines)
    paragraphs = [p for p in map(str.strip, _PARAGRAPH.split(text)) if p]
    if paragraphs:
        out["dup_paragraph_share"] = 1 - len(set(paragraphs)) / len(paragraphs)
    if n_words:
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for w in words])
        distinct = len(known)
        times = np.bincount(codes)
        out["mean_word_length"] = letters / n_words
        out["common_word_share"] = sum(int(times[known[w]]) for w in COMMON & known.keys()) / n_words
        out["distinct_word_share"] = distinct / n_words
        if n_words >= 2:
            lengths = np.array(list(map(len, words)))
            pairs = codes[:-1] * distinct + codes[1:]
            out["top_2gram_share"], often = top_share(pairs, lengths, 2, letters)
            if n_words >= 3:
                out["top_3gram_share"], often = top_share(pairs[:-1] * distinct + codes[2:], lengths, 3, letters) if often > 1 else (0.0, 1)
            if n_words >= 4:
                mixed = pairs[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pairs[2:].astype(np.uint64)
                out["top_4gram_share"], often = top_share(mixed, lengths, 4, letters) if often > 1 else (0.0, 1)
    else:
        distinct = 0

    weight = dict.fromkeys((*KINDS, "short"), 0)
    n_short = n_lower = 0
    for line in lines:
        kind = line_kind(line)
        if kind:
            if kind == "short":
                n_short += 1
                n_lower += line[0].islower()
            weight[kind] += (len(_TAG.sub("", line).strip()) or 1) if "<" in line else len(line)
    wrapped = n_lower >= 0.25 * n_short and weight["text"] >= 0.2 * weight["short"]
    weight["text" if wrapped else "list"] += weight.pop("short")
    total = sum(weight.values())
    for kind in KINDS:
        out[f"{kind}_share"] = weight[kind] / total if total else 0.0

    noise = False
    if n_words >= 20 and not chinese and distinct <= 12:
        noise = True  # a few words over and over
    elif not text.isascii() and sum(map(len, _MANGLED.findall(text))) > 0.08 * len(text):
        noise = True  # wrongly decoded
    elif n_words >= 10 and not chinese and out["common_word_share"] < 0.1:
        plain = _INLINE.sub(" ", text) if "\\" in text else text
        alphabetic = sum(map(str.isalpha, plain))
        noise = alphabetic >= 40 and len(_VOWEL.findall(plain)) < 0.2 * alphabetic  # letters that no language puts together
    if noise and weight["table"] < 0.5 * total:
        kind = "junk"
    elif not total:
        kind = "text" if chinese or n_words else "junk"
    else:
        kind = max(KINDS, key=lambda k: weight[k])
        if kind != "text" and weight[kind] <= weight["text"]:
            kind = "text"
        repeated = len(lines) >= 8 and out["dup_line_share"] >= 0.75 or len(paragraphs) >= 8 and out["dup_paragraph_share"] >= 0.75
        if kind == "text" and (repeated or often >= 8 and out["top_4gram_share"] >= 0.25):
            kind = "junk"  # one sentence, notice or paragraph over and over
    out["kind"] = kind
    return out


NUMBERS = [
    "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "distinct_word_share", "dup_line_share", "dup_paragraph_share",
    "top_2gram_share", "top_3gram_share", "top_4gram_share", "text_share", "list_share", "table_share", "junk_share",
]


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id, its statistics and ``kind`` (text, list, table, junk; null for blank texts).

    Rows are kept as they are, repeated ones and null ids too; an empty table gives an empty table; other columns
    are not read. One pass, no shuffle.
    """
    ship(df.sparkSession)
    counts = ["n_chars", "n_words", "n_lines"]
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join([f"{c} bigint" for c in counts] + [f"{c} double" for c in NUMBERS] + ["kind string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in counts] + [pa.array([r[c] for r in rows], pa.float64()) for c in NUMBERS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r["kind"] for r in rows], pa.string())], names=["doc_id", *counts, *NUMBERS, "kind"])

    return source.mapInArrow(run, schema)


def not_running_text(statistics: DataFrame, least_chars: int = 20) -> DataFrame:
    """(doc_id, kind) of the texts of at least ``least_chars`` characters that are a list, a table or junk."""
    return statistics.where((F.col("n_chars") >= least_chars) & F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")
