"""Canvas, grid and resize arithmetic as Spark columns, and the fonts of a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import has_cjk


@dataclass(frozen=True)
class Canvas:
    """Limits of a page image in pixels; sizes are multiples of ``step``."""

    min_width: int = 256
    max_width: int = 1024
    min_height: int = 64
    max_height: int = 512
    step: int = 32


# The sizes a page image may have.
WIDTHS = (256, 384, 512, 640, 768, 896, 1024)
HEIGHTS = (64, 96, 128, 192, 256, 320, 384, 448, 512)


def up(c: Column, step: int) -> Column:
    return (F.ceil(c / step) * step).cast("int")


def canvas_size(content_w: Column, content_h: Column, top: Column, bottom: Column, left: Column, right: Column, extra_w: Column | None = None, extra_h: Column | None = None, canvas: Canvas = Canvas()) -> Column:
    """Content, margins and slack rounded up, cut to the greatest size (which is an overflow), then widened to the least."""
    zero = F.lit(0)
    width = up(content_w + left + right + (zero if extra_w is None else extra_w), canvas.step)
    height = up(content_h + top + bottom + (zero if extra_h is None else extra_h), canvas.step)
    overflow = (width > canvas.max_width) | (height > canvas.max_height)
    w = F.greatest(F.least(width, F.lit(canvas.max_width)), F.lit(canvas.min_width))
    h = F.greatest(F.least(height, F.lit(canvas.max_height)), F.lit(canvas.min_height))
    gw, gh = F.floor(w / canvas.step).cast("int"), F.floor(h / canvas.step).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), gw.alias("grid_w"), gh.alias("grid_h"), (gw * gh).alias("visual_tokens"), overflow.alias("overflow"))


def is_valid_canvas(w: Column, h: Column, canvas: Canvas = Canvas()) -> Column:
    return (F.pmod(w, F.lit(canvas.step)) == 0) & (F.pmod(h, F.lit(canvas.step)) == 0) & w.between(canvas.min_width, canvas.max_width) & h.between(canvas.min_height, canvas.max_height)


def choose_bucket(value: Column, buckets: tuple[int, ...]) -> Column:
    """The least bucket that holds the value; null if none does (the page must be split)."""
    return F.array_min(F.filter(F.array(*[F.lit(b) for b in buckets]), lambda b: b >= value))


def width_candidates(has_table: Column, has_display: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """Widths to try, the widest first; tables and display formulas need wide pages."""
    least = F.when(has_table, 768).when(has_display, 512).otherwise(0)
    return F.filter(F.array(*[F.lit(w) for w in sorted(widths, reverse=True)]), lambda w: w >= least)


def required_height(content_h: Column, padding: Column, slack: Column) -> Column:
    return content_h + padding * 2 + slack


def estimated_content(cost_chars: Column, width: Column, font_size: Column, line_height: Column) -> Column:
    """A deterministic stand-in for a browser's measurement: lines of average glyphs."""
    per_line = F.greatest(F.floor(width / (font_size * 0.5)), F.lit(1))
    return F.ceil(F.ceil(cost_chars / per_line) * font_size * line_height).cast("int")


def smart_resize(height: Column, width: Column, factor: int = 32, least: int = 224 * 224, most: int = 3_200_000) -> Column:
    """(height, width) rounded (half to even) to the factor, rescaled into the pixel limits."""
    snap = lambda c, f: F.greatest(F.lit(factor), (f(c / factor) * factor).cast("int"))
    h, w = snap(height.cast("double"), F.rint), snap(width.cast("double"), F.rint)
    area = (height * width).cast("double")
    down, upward = F.sqrt(area / F.lit(float(most))), F.sqrt(F.lit(float(least)) / area)
    pick = lambda c, plain: F.when(h * w > most, snap(c / down, F.floor)).when(h * w < least, snap(c * upward, F.ceil)).otherwise(plain)
    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))


def coordinates(grid_h: Column, grid_w: Column) -> Column:
    """One struct for each cell, row by row: its relative place and the logarithms of the grid."""
    share = lambda k, n: F.when(n > 1, k / (n - 1)).otherwise(F.lit(0.0))
    cell = lambda y, x: F.struct(y.alias("row"), x.alias("col"), share(x, grid_w).alias("x"), share(y, grid_h).alias("y"), F.log(grid_h.cast("double")).alias("log_h"), F.log(grid_w.cast("double")).alias("log_w"))
    return F.flatten(F.transform(F.sequence(F.lit(0), grid_h - 1), lambda y: F.transform(F.sequence(F.lit(0), grid_w - 1), lambda x: cell(y, x))))


# The first family of each kind of font.
FIRST_FONT = {"serif": "Times New Roman", "sans_serif": "Arial", "monospace": "Courier New", "cjk": "Noto Sans CJK SC"}


def font_stack(text: Column, category: Column, preferred: Column | None = None) -> Column:
    """A CSS font list, with a CJK family where the text needs one."""
    families = F.create_map(*[F.lit(x) for kv in FIRST_FONT.items() for x in kv])
    primary = F.coalesce(families[category], F.lit("Arial")) if preferred is None else F.coalesce(preferred, families[category], F.lit("Arial"))
    quoted = F.concat(F.lit('"'), primary, F.lit('"'))
    return F.concat(quoted, F.when(has_cjk(text), F.lit(f', "{FIRST_FONT["cjk"]}"')).otherwise(""), F.lit(", serif"))


def as_boolean(c: Column) -> Column:
    """Whether a string says yes."""
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")
