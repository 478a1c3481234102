import numpy as np
import pytest

from pagemill.operators import render as G
from pagemill.operators.blocks import parse


def test_plans(spark, data):
    pages = spark.read.parquet(f"{data}/page_records.parquet")
    rows = G.planned(pages).collect()
    assert len(rows) == pages.where("size(blocks) > 0").count()
    for r in rows:
        if r.reject_reason is None:
            assert r.visual_tokens == (r.width // 32) * (r.height // 32) and r.content_h + 32 <= r.height
        else:
            assert r.reject_reason in ("needs_split", "too_wide") and r.width is None


def test_tables_are_wide():
    blocks = parse("| a | b |\n|---|---|\n| 1 | 2 |")
    assert G.plan_one(G.EstimatedLayout(), "k", blocks)[1] == 1024
    assert G.plan_one(G.EstimatedLayout(), "k", parse("word " * 5000))[-1] == "needs_split"
    wide = "| " + " | ".join(["cell" * 20] * 8) + " |\n|---|---|\n| 1 |"
    assert G.plan_one(G.EstimatedLayout(), "k", parse(wide))[-1] == "too_wide"


def test_pixels():
    image = np.arange(3 * 4 * 6).reshape(3, 4, 6)
    p = G.patches(image, 2)
    assert p.shape == (6, 3, 2, 2) and (p[1] == image[:, :2, 2:4]).all()
    with pytest.raises(ValueError):
        G.patches(image, 5)
    assert G.stacked([np.ones((3, 2, 5)), np.ones((3, 4, 1))]).shape == (2, 3, 4, 5)
    raw = np.zeros((2, 2, 3), np.uint8)
    assert G.decoded(raw, "uint8").dtype == np.uint8 and G.decoded(raw, "float11").min() == -1.0 and G.normalised(raw).max() == -1.0
    assert G.tensor_of(np.ones(6, np.float16).tobytes(), "2,3").shape == (2, 3)


def test_augmentation_depends_on_the_seed_alone():
    image = np.random.default_rng(1).integers(0, 256, (16, 24, 3), dtype=np.uint8)
    assert G.augmented(image, "clean", 1) is image
    for level in ("mild", "hard"):
        assert (G.augmented(image, level, 5) == G.augmented(image, level, 5)).all() and (G.augmented(image, level, 5) != G.augmented(image, level, 6)).any()
