import math
import random

import pytest

from pagemill.llm.mixing import capped_mean, mix, plan, rate_for, source_name, steps

TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("cap", [1, 2, 4, 8])
@pytest.mark.parametrize("share", [0.05, 0.4, 0.9, 0.99, 1.0])
def test_rates_have_the_means(cap, share):
    rate = rate_for(share * cap, cap)
    if share == 1.0:
        assert math.isinf(rate) and steps(rate, cap) == [0.0] * cap
    else:
        assert abs(capped_mean(rate, cap) - share * cap) < 1e-6
        marks = steps(rate, cap)
        assert marks == sorted(marks)
        mean = sum(sum(u >= m for m in marks) for u in (k / 20_000 for k in range(20_000))) / 20_000
        assert abs(mean - share * cap) < 0.002 * cap


def documents(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        source = rnd.choice(["big"] * 6 + ["middle"] * 3 + ["small"])
        rows.append((k, "word " * rnd.randint(5, 60), rnd.choice([source, source.upper(), f" {source} "]), 1))
    rows += [(n, None, "big", 1), (n + 1, "", "big", 1), (n + 2, "unlisted text", "other", 1), (n + 3, "no source", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_shares_and_caps(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("middle", 0.3, 2), ("small", 0.15, 6), ("absent", 0.05, 3)], TARGETS)
    mixture, shares = mix(docs, targets)
    rows, report = mixture.collect(), {r.source: r for r in shares.collect()}
    used = {}
    for r in rows:
        used.setdefault((r.source, r.doc_id), []).append(r.copy)
    cap = {"big": 1, "middle": 2, "small": 6}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= cap[s] for (s, _), c in used.items())
    total = sum(r.n_tokens for r in rows)
    for s, share in (("big", 0.5), ("middle", 0.3), ("small", 0.15)):
        actual = sum(r.n_tokens for r in rows if r.source == s) / total
        assert abs(actual - report[s].actual_share) < 1e-9 and abs(actual - share / 0.95) < 0.01
    assert report["absent"].actual_share == 0
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)
    again = mix(docs.repartition(5), targets)[0].collect()
    assert [(r.doc_id, r.copy) for r in again] == [(r.doc_id, r.copy) for r in rows]


def test_total_beyond_a_cap():
    rows = [{"source": "a", "target_share": 0.5, "max_repeats": 2}, {"source": "b", "target_share": 0.5, "max_repeats": 1}]
    got = {p["source"]: p["mean"] for p in plan(rows, {"a": 10, "b": 100}, total=100)}
    assert got == {"a": 2, "b": 0.5}


def test_empty_and_odd_tables(spark):
    docs = documents(spark, 20)
    none = spark.createDataFrame([], TARGETS)
    assert mix(docs, none)[0].count() == 0 and mix(docs, none)[1].count() == 0
    targets = spark.createDataFrame([("big", 1.0, 1), ("BIG", 0.5, 1), (None, 0.5, 1), ("zero", 0.0, 1), ("never", 0.3, 0)], TARGETS)
    mixture, shares = mix(docs.where("false"), targets)
    assert mixture.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}
    mixture, shares = mix(docs, targets)
    assert {r.source for r in mixture.collect()} == {"big"} and sum(r.actual_share for r in shares.collect()) == 1.0


def test_source_names(spark):
    df = spark.createDataFrame([("Lecture-Scans ",), ("lecture scans",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(df.s)).collect()] == ["lecture_scans", "lecture_scans", None, None]
