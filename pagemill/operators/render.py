"""The renderer as an interface, with a deterministic estimator and pixel operators where numpy is enough.

Rasterising needs a browser, which is an external runtime: a ``LayoutEngine`` is what one implements. Without one,
``EstimatedLayout`` plans canvases and reject reasons from the text alone; it makes no pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.layout import HEIGHTS, WIDTHS

PLAN = "id string, width int, height int, grid_w int, grid_h int, visual_tokens int, content_h int, reject_reason string"


@dataclass(frozen=True)
class Measure:
    width: int
    height: int
    too_wide: bool = False


class LayoutEngine(Protocol):
    """One per worker, made on first use; it must come with its own start-up."""

    def measure(self, blocks: list[dict], width: int, font_size: int, line_height: float) -> Measure: ...


class EstimatedLayout:
    """Average glyph widths; formulas and tables by the weights that packing uses."""

    glyph = 0.5

    def measure(self, blocks: list[dict], width: int, font_size: int, line_height: float) -> Measure:
        per_line = max(1, int(width / (font_size * self.glyph)))
        lines, widest = 0, 0
        for b in blocks:
            kind = b["kind"]
            rows = b["rows"] if b["rows"] is not None else []
            if kind == "table":
                lines += len(rows) + 1
                widest = max([widest, *(sum(len(c or "") + 3 for c in row) for row in rows)])
            elif kind == "math_display":
                lines += 3
                widest = max(widest, len(b["tex"] or ""))
            else:
                parts = b["parts"] if b["parts"] is not None else []
                lines += math.ceil(max(1, sum(len((p["text"] or p["tex"] or "")) for p in parts)) / per_line)
        return Measure(width, math.ceil(lines * font_size * line_height), widest > 2 * per_line)


def plan_one(engine: LayoutEngine, key: str, blocks: list[dict], font_size: int = 26, line_height: float = 1.5, padding: int = 16, patch: int = 32, widths=WIDTHS, heights=HEIGHTS) -> tuple:
    """A page's canvas: the widest width that does not overflow and the least height that holds it, or why there is none."""
    kinds = {b["kind"] for b in blocks}
    least = 768 if "table" in kinds else 512 if "math_display" in kinds else 0
    for width in sorted((w for w in widths if w >= least), reverse=True):
        seen = engine.measure(blocks, width - 2 * padding, font_size, line_height)
        if seen.too_wide:
            continue
        need = seen.height + 2 * padding
        height = next((h for h in sorted(heights) if h >= need), None)
        if height is None:
            return key, None, None, None, None, None, seen.height, "needs_split"
        return key, width, height, width // patch, height // patch, (width // patch) * (height // patch), seen.height, None
    return key, None, None, None, None, None, None, "too_wide"


def planned(pages: DataFrame, engine=EstimatedLayout, id_col: str = "id", blocks_col: str = "blocks") -> DataFrame:
    """A canvas or a reject reason for each page that has blocks; the engine is made once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = engine()
        for pdf in batches:
            yield pd.DataFrame([plan_one(made, k, list(b)) for k, b in zip(pdf["id"], pdf["blocks"])], columns=[c.split()[0] for c in PLAN.split(", ")])

    return pages.where(F.size(blocks_col) > 0).select(F.col(id_col).alias("id"), F.col(blocks_col).alias("blocks")).mapInPandas(run, PLAN)


def patches(image: np.ndarray, size: int) -> np.ndarray:
    """[C, H, W] as [(H/p)(W/p), C, p, p], row by row."""
    c, h, w = image.shape
    if h % size or w % size:
        raise ValueError("the image is no multiple of the patch")
    return image.reshape(c, h // size, size, w // size, size).transpose(1, 3, 0, 2, 4).reshape(-1, c, size, size)


def normalised(image: np.ndarray, mean: float = 0.5, std: float = 0.5) -> np.ndarray:
    return (image.astype(np.float32) / 255.0 - mean) / std


def decoded(image: np.ndarray, mode: str) -> np.ndarray:
    """[H, W, 3] bytes as uint8, float01 or float11 in [3, H, W]."""
    planes = np.ascontiguousarray(image.transpose(2, 0, 1))
    if mode == "uint8":
        return planes
    scaled = planes.astype(np.float32) / 255.0
    return scaled if mode == "float01" else scaled * 2.0 - 1.0


def stacked(images: list[np.ndarray]) -> np.ndarray:
    """Images padded with zeros to the greatest height and width of the batch."""
    h, w = (max(i.shape[k] for i in images) for k in (1, 2))
    return np.stack([np.pad(i, ((0, 0), (0, h - i.shape[1]), (0, w - i.shape[2]))) for i in images])


def tensor_of(data: bytes, shape: str, dtype: str = "float16") -> np.ndarray:
    """An array from its bytes and a shape like ``3,512,1024``."""
    return np.frombuffer(data, dtype=dtype).reshape([int(n) for n in shape.split(",")])


def augmented(image: np.ndarray, level: str, seed: int) -> np.ndarray:
    """[H, W, C] bytes: clean stays, mild changes light and adds noise, hard also blurs, shades and shifts rows.

    All magnitudes come from the row's own seed, so a page looks the same in every run.
    """
    if level == "clean":
        return image
    rng = np.random.default_rng(seed)
    x = image.astype(np.float32)
    strength = 1.0 if level == "mild" else 2.0
    x = (x - 128.0) * (1.0 + rng.uniform(-0.1, 0.1) * strength) + 128.0 + rng.uniform(-8, 8) * strength
    if level == "hard":
        x = (x + np.roll(x, 1, axis=0) + np.roll(x, 1, axis=1) + np.roll(x, -1, axis=0) + np.roll(x, -1, axis=1)) / 5.0
        x *= np.linspace(1.0, rng.uniform(0.75, 0.95), x.shape[1], dtype=np.float32)[None, :, None]
        x = np.roll(x, int(rng.integers(-2, 3)), axis=1)
    x += rng.normal(0.0, 2.0 * strength, x.shape)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)
