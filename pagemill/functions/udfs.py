"""What Spark's own functions cannot say, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import html
import random
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.schemas import TASK


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


_WRAPPED = re.compile(r"\\(?:textbf|textit|emph|mathrm|mathbf|mathit|textsubscript|textsuperscript)\{([^{}]*)\}")


def unwrapped(text: str) -> str:
    """Without bold, italic, roman and super- or subscript text commands, however deep they are nested."""
    while (bare := _WRAPPED.sub(r"\1", text)) != text:
        text = bare
    return text


@F.pandas_udf(T.StringType())
def unwrap(s: pd.Series) -> pd.Series:
    return s.map(unwrapped, na_action="ignore")


def stable_seed_of(*parts: object) -> int:
    """64 bits of BLAKE2b over the parts' text, joined by U+001F, little-endian."""
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest, "little")


@F.pandas_udf(T.StringType())
def stable_seed(key: pd.Series, epoch: pd.Series) -> pd.Series:
    """As a decimal string, since 64 unsigned bits do not fit a bigint."""
    return pd.Series([str(stable_seed_of(k, e)) for k, e in zip(key, epoch)])


def reduced_seed(*parts: object) -> int:
    """The first 16 hex digits of SHA-256 over the parts joined by bars, modulo 2**31."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16) % 2**31


# The shares of the tasks, in drawing order.
TASK_WEIGHTS = {"full_ocr": 0.60, "optical_continuation": 0.10, "span_reconstruction": 0.20, "text_replay": 0.10}


_BOUNDARY = re.compile(r"\n|[.!?。！？](?=[ \n])")


def boundaries_of(text: str) -> list[int]:
    return sorted({0, *(m.end() for m in _BOUNDARY.finditer(text)), len(text)})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def boundaries(s: pd.Series) -> pd.Series:
    return s.map(boundaries_of, na_action="ignore")


def build_task(name: str, text: str, rng: random.Random) -> dict:
    """One training task of a text; a text too short for its task becomes full OCR.

    The draws follow CPython's generator, so a seed gives the same task everywhere.
    """
    task = dict(task_type="full_ocr", prefix_text="", visual_text=text, suffix_text="", target_text=text, is_text_only=False)
    if name == "text_replay":
        return task | {"task_type": name, "visual_text": "", "is_text_only": True}
    marks = boundaries_of(text)
    least = {"optical_continuation": 100, "span_reconstruction": 60}.get(name)
    if least is None or len(text) < least or len(marks) < 3:
        return task
    rebuilt = lambda context, seen: task | {"task_type": "span_reconstruction", "prefix_text": context, "visual_text": seen, "target_text": seen}
    last = len(marks) - 1
    if name == "optical_continuation":
        begin = rng.randint(1, last - 1)
        end = next((k for k in range(begin + 1, last + 1) if marks[k] - marks[begin] >= 300), last)
        before, seen, rest = (text[a:b].strip() for a, b in ((0, marks[begin]), (marks[begin], marks[end]), (marks[end], None)))
        if len(seen) < 10:
            return task
        if len(rest) < 10:
            return rebuilt(before, seen)
        return task | {"task_type": name, "prefix_text": before, "visual_text": seen, "suffix_text": rest, "target_text": rest}
    for _ in range(10):
        begin = rng.randint(0, last - 1)
        end = rng.randint(begin + 1, min(begin + 5, last))
        seen = text[marks[begin] : marks[end]].strip()
        if 15 < len(seen) < 500:
            sides = text[marks[end] :].strip(), text[: marks[begin]].strip()
            return rebuilt(max(sides, key=len), seen)
    return rebuilt(text[marks[1] :].strip(), text[: marks[1]].strip())


def sample_task(weights: dict[str, float] | None = None, seed: int = 42):
    """A UDF (id, text, epoch) -> task."""
    weights = weights or TASK_WEIGHTS

    @F.pandas_udf(TASK)
    def sampled(ids: pd.Series, texts: pd.Series, epochs: pd.Series) -> pd.DataFrame:
        rows = []
        for key, text, epoch in zip(ids, texts, epochs):
            rng = random.Random(reduced_seed("" if key is None else key, "task", epoch, seed))
            name = rng.choices(list(weights), weights=list(weights.values()), k=1)[0]
            rows.append(build_task(name, text or "", rng))
        return pd.DataFrame(rows, columns=["task_type", "prefix_text", "visual_text", "suffix_text", "target_text", "is_text_only"])

    return sampled


# Layouts (weight, margin multiplier, widest content, fonts), ranges and difficulty shares.
LAYOUTS = {
    "scientific_paper": (0.30, 1.3, 800, "serif"),
    "textbook": (0.20, 1.2, 750, "serif"),
    "news_web": (0.15, 0.8, 700, "sans_serif"),
    "blog": (0.10, 1.0, 720, "sans_serif"),
    "documentation": (0.10, 1.1, 900, "monospace"),
    "terminal": (0.05, 0.6, 640, "monospace"),
    "report": (0.05, 1.4, 780, "serif"),
    "dense_text": (0.05, 0.5, 960, "serif"),
}
FONTS = {"serif": ["Times New Roman", "Georgia", "Noto Serif"], "sans_serif": ["Arial", "Helvetica", "Noto Sans"], "monospace": ["Courier New", "Consolas", "Noto Sans Mono"]}
DIFFICULTY = {"clean": 0.80, "mild": 0.18, "hard": 0.02}

STYLE = (
    "struct<layout_style:string,font_family:string,font_size:int,line_height:double,letter_spacing:double,font_style:string,font_weight:string,"
    "top_margin:int,bottom_margin:int,left_margin:int,right_margin:int,max_content_width:int,difficulty:string,text_align:string,"
    "formula_size_mult:double,table_font_size_pct:int,seed:int>"
)


def style_of(key: str, epoch: int, seed: int = 42, difficulty: dict[str, float] | None = None) -> tuple:
    """A page style; the draws are made in the order of the fields."""
    number = reduced_seed(key, epoch, seed)
    rng = random.Random(number)
    pick = lambda shares: rng.choices(list(shares), weights=list(shares.values()), k=1)[0]
    layout = pick({name: values[0] for name, values in LAYOUTS.items()})
    _, spread, width, family = LAYOUTS[layout]
    size = rng.randint(18, 34)
    line_height, spacing = round(rng.uniform(1.2, 1.8), 2), round(rng.uniform(0.0, 0.03), 3)
    font = rng.choice(FONTS[family])
    slant, weight = pick({"normal": 0.85, "italic": 0.15}), pick({"normal": 0.90, "bold": 0.10})
    margins = [int(rng.randint(16, 64) * spread) for _ in range(4)]
    hard = pick(difficulty or DIFFICULTY)
    align = rng.choice(["justify", "left"])
    return (layout, font, size, line_height, spacing, slant, weight, *margins, width, hard, align, 1.0 + (size - 26) * 0.02, max(70, min(100, int(size / 26 * 100))), number)


def sample_style(seed: int = 42, difficulty: dict[str, float] | None = None):
    """A UDF (id, epoch) -> style."""

    @F.pandas_udf(STYLE)
    def sampled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, epochs in batches:
            yield pd.DataFrame([style_of(k, e, seed, difficulty) for k, e in zip(ids, epochs)], columns=[f.split(":")[0] for f in STYLE[7:-1].split(",")])

    return sampled
