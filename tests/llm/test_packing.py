import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm.packing import best_fit, best_fit_report, fill_report, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=150), st.integers(1, 12), st.sampled_from(["norm", "dot"]), st.sampled_from([4_000.0, 7_000.0]))
def test_every_constraint_holds(lengths, most, rule, attention):
    lengths = np.array(lengths, dtype=np.int64)
    bins = best_fit(lengths, 100, most, attention, rule)
    assert len(bins) == len(lengths)
    for b in set(bins.tolist()):
        held = lengths[bins == b]
        assert held.sum() <= 100 and len(held) <= most and ((held**2).sum() <= attention or len(held) == 1)
    assert sorted(set(bins.tolist())) == list(range(len(set(bins.tolist()))))


def test_little_room_is_lost():
    lengths = np.random.default_rng(1).integers(20, 900, 4000)
    for rule in ("norm", "dot"):
        bins = best_fit(lengths, 2048, 256, 2048.0**2, rule)
        assert lengths.sum() / (2048 * (bins.max() + 1)) > 0.98


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_table string, item_id string, length int").withColumns({"part": F.lit("clash"), "container": F.lit(1), "block": F.lit(2)})


def test_all_items_come_out(spark):
    rows = [("a", f"i{k}", (k * 37) % 700) for k in range(500)] + [("b", "long", 5000), ("b", "exact", 2048), ("b", "one more", 2049), ("b", "null", None), ("b", "empty", 0), ("a", "i1", 37)]
    got = pack(frame(spark, rows), 2048, block_items=100).collect()
    whole = {}
    for r in got:
        whole[r.item_table, r.item_id] = whole.get((r.item_table, r.item_id), 0) + r.length
    expected = {}
    for t, i, n in rows:
        expected[t, i] = expected.get((t, i), 0) + (n or 0)
    assert whole == expected
    assert sorted((r.part, r.length) for r in got if r.item_id == "long") == [(0, 2048), (1, 2048), (2, 904)]
    assert sorted(r.item_id for r in got if r.container is None) == ["empty", "i0", "null"] or {r.item_id for r in got if r.container is None} >= {"empty", "null"}
    used = {}
    for r in got:
        if r.container:
            used.setdefault(r.container, []).append(r)
    assert all(sum(r.length for r in rs) <= 2048 and len({r.item_table for r in rs}) == 1 for rs in used.values())
    again = pack(frame(spark, rows).repartition(7), 2048, block_items=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    report = {r.item_table: r for r in fill_report(pack(frame(spark, rows), 2048), 2048).collect()}
    assert report["a"].most_used <= 2048 and report["a"].n_containers >= report["a"].least_containers


def test_empty_and_bad(spark):
    assert pack(frame(spark, []), 2048).count() == 0
    assert pack(frame(spark, [("a", "x", None)]), 2048).collect()[0].container is None
    with pytest.raises(ValueError):
        pack(frame(spark, []), 0)


def test_a_costly_item_has_a_container_to_itself(spark):
    got = pack(frame(spark, [("a", "x", 100), ("a", "y", 1)]), 101, attention=2500.0).collect()
    assert sorted(r.length for r in got) == [1, 100] and len({r.container for r in got}) == 2


def test_other_capacities_bind_and_cost_little(spark):
    lengths = np.random.default_rng(2).integers(20, 1900, 3000)
    free, refused = best_fit_report(lengths, 2048, 256, 2048.0**2)
    assert not refused.any()
    bound, refused = best_fit_report(lengths, 2048, 256, 0.7 * 2048**2)
    assert (refused > 0).sum() > 100 and bound.max() <= 1.05 * free.max()
    short = np.full(100, 5)
    bins, refused = best_fit_report(short, 2048, 16, 0.7 * 2048**2)
    assert bins.max() + 1 == 7
    rows = {r.item_table: r for r in fill_report(pack(frame(spark, [("a", str(k), int(n)) for k, n in enumerate(lengths)] + [("b", str(k), 5) for k in range(100)]), 2048), 2048).collect()}
    assert rows["a"].n_refused > 100 and rows["b"].n_full_by_items == 6 and rows["b"].n_containers == 7


def test_equal_rows_spread_over_blocks(spark):
    got = pack(frame(spark, [("a", "same", 700)] * 300), 2048, block_items=50).collect()
    assert len(got) == 300 and len({r.container.rsplit("-", 1)[0] for r in got}) > 3
