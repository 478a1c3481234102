import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import layout as L
from pagemill.operators import dedup as D
from pagemill.operators import positions as N
from pagemill.operators import qc as Q
from pagemill.operators import schedule as C
from pagemill.operators import vocab as V
from pagemill.session import materialize, release
from pagemill.sources import records as R
from pagemill.sources import sinks as K
from pagemill.streaming import ingest as I


def test_first_copies(spark):
    df = D.with_digest(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "k int, text string"))
    assert sorted(r.k for r in D.first_copies(df, ["k"]).collect()) == [1, 2, 4]
    seen = df.where("k = 2").select("sha1")
    assert sorted(r.k for r in D.first_copies(df.where("text is not null"), ["k"], seen=seen).collect()) == [1]
    assert D.first_copies(df.where("false"), ["k"]).count() == 0


def test_splits_do_not_depend_on_order(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    a = {r.k: r.s for r in df.select("k", D.split_of(F.col("k"), 0.1, 0.1).alias("s")).collect()}
    assert a == {r.k: r.s for r in df.repartition(7).select("k", D.split_of(F.col("k"), 0.1, 0.1).alias("s")).collect()}
    assert abs(sum(s == "train" for s in a.values()) / 3000 - 0.8) < 0.03


def test_rolled_shards(spark):
    df = spark.createDataFrame([("train", k, "x" * n) for k, n in enumerate([5, 5, 5, 30, 1, 9, 2])], "split string, k int, line string")
    got = [r.shard for r in D.rolled_shards(df, "line", "k", 10).orderBy("k").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("most,lane", [(10, 1), (10, 3), (25, 7), (60, 4), (10, 1000)])
def test_lanes_roll_like_one_fold(spark, most, lane):
    rnd = random.Random(most * lane)
    rows = [(k, rnd.choice(["a", None]), "x" * rnd.choice([0, 0, 1, 3, 5, 9, 12, 30])) for k in range(140)]
    want = {}
    for g in ("a", None):
        used = shard = 0
        for k, own, line in rows:
            if own == g:
                if used and used + len(line) > most:
                    used, shard = 0, shard + 1
                used += len(line)
                want[k] = g, shard
    got = D.rolled_shards(spark.createDataFrame(rows, "k int, split string, line string"), "line", "k", most, lane_rows=lane).collect()
    assert {r.k: (r.split, r.shard) for r in got} == want and len(got) == len(rows)


def test_ties_are_divided(spark):
    df = spark.range(4000).selectExpr("id", "1 AS v")
    placed = N.with_position(df, ["v"])
    assert sorted(r.pos for r in placed.collect()) == list(range(4000))
    from pagemill.operators.positions import _IN_TASK

    parts = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(4, "v", "__tie").groupBy(F.spark_partition_id()).count().collect()
    assert _IN_TASK == 33 and len(parts) == 4 and max(r["count"] for r in parts) < 2500


def test_positions(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(1000), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(6)
    got = {r.k: r.pos for r in N.with_position(df, ["v", "k"]).collect()}
    assert got == {k: p for p, (_, _, k) in enumerate(sorted(rows, key=lambda r: r[1:]))}
    placed = N.with_group_position(df, ["g"], ["v", "k"]).collect()
    for g in ("a", "b", None):
        own = sorted(r[1:] for r in rows if r[0] == g)
        assert [(r.v, r.k) for r in sorted((r for r in placed if r.g == g), key=lambda r: r.pos)] == own and {r.pos_of for r in placed if r.g == g} == {len(own)}
    assert N.with_position(df.where("false"), ["v"]).count() == 0 and N.with_group_position(df.where("false"), ["g"], ["v"]).count() == 0
    for n in (3, 8, 10):
        sizes = spark.range(n).select(N.chunk_of(F.col("id"), F.lit(n), 4).alias("c")).groupBy("c").count().orderBy("c").collect()
        assert [r["count"] for r in sizes] == [n // 4 + (k < n % 4) for k in range(4) if n // 4 + (k < n % 4)]


def test_batches(spark):
    df = spark.createDataFrame([(k, k % 2 or None, 3) for k in range(21)], "k int, grid_h int, grid_w int")
    sizes = lambda d: sorted(r["count"] for r in d.groupBy("grid_h", "batch").count().collect())
    assert sizes(D.bucket_batches(df, 4, "k")) == [2, 4, 4] and sizes(D.bucket_batches(df, 4, "k", drop_last=True)) == [4, 4]


def test_interleave_keeps_all(spark):
    a, b = spark.range(90).withColumnRenamed("id", "k"), spark.range(1000, 1010).withColumnRenamed("id", "k")
    rows = [r.origin for r in D.interleave(a, b, 0.1, "k").orderBy("place", "k").collect()]
    assert rows.count("main") == 90 and rows.count("other") == 10 and "other" in rows[:50]
    assert D.interleave(a, b.where("false"), 0.1, "k").count() == 90


def test_vocabulary(spark, tmp_path):
    lines = spark.createDataFrame([(0, "a"), (1, ""), (2, "a"), (3, "é"), (4, "")], "line_no int, value string")
    vocabulary = V.from_lines(lines)
    assert {(r.token, r.id) for r in vocabulary.collect()} == {("a", 0), ("\n", 1), ("é", 2)}
    texts = spark.createDataFrame([(1, "aé\nz"), (2, ""), (3, None)], "k int, text string")
    got = {r.k: r.ids for r in V.encode_rows(texts, vocabulary, "k", "text").collect()}
    assert got == {1: [0, 2, 1, 2], 2: [], 3: None}
    assert {r.token: r.id for r in V.extended(vocabulary, V.characters(texts)).collect()} == {"a": 0, "\n": 1, "é": 2, "z": 3}
    c = V.coverage(V.characters(texts), vocabulary).first()
    assert (c.n_chars, c.n_known, c.n_occurrences, c.n_covered) == (4, 3, 4, 3)
    K.write_vocabulary(vocabulary, str(tmp_path / "v"))
    back = spark.read.text(str(tmp_path / "v")).collect()
    assert [r.value for r in back] == ["a", "", "é"]
    with pytest.raises(ValueError):
        V.as_map(vocabulary, most=2)


def test_issues(spark):
    rows = [("", "ok"), ("a", None), ("b", "x\x01\x02y\n\t"), ("c", "\\(a\\) \\(b"), ("d", "\\[a"), ("e", "fine \\(x\\)"), ("f", "\\(a\\|b\\|c")]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {r.id: list(r.i) for r in df.select("id", Q.issues(F.col("id"), F.col("t")).alias("i")).collect()}
    assert got == {"": ["missing id"], "a": ["empty target_text"], "b": ["control_chars=2"], "c": ["latex_paren_mismatch: 2 vs 1"], "d": ["latex_bracket_mismatch: 1 vs 0"], "e": [], "f": ["latex_paren_mismatch: -1 vs 0"]}


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_percentiles(spark, n):
    values = [random.Random(n).randrange(10) for _ in range(n)]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None)], "g string, v double")
    ordered = sorted(values)
    assert Q.floor_percentile(df, "g", "v").first().p_floor == ordered[min(int(0.95 * n), n - 1)]
    at = (n - 1) * 0.95
    low = math.floor(at)
    assert Q.percentiles(df, "g", "v").first().p95 == pytest.approx(ordered[low] + (at - low) * (ordered[min(low + 1, n - 1)] - ordered[low]))


def test_layout(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for h, w, n in ((512, 1024, 512), (256, 64, 16), (768, 192, 144)):
        assert (h // 32) * (w // 32) == n
    c = one(L.canvas_size(*[F.lit(v) for v in (900, 700, 10, 10, 10, 10)]))
    assert (c.width, c.height, c.grid_w, c.grid_h, c.visual_tokens, c.overflow) == (928, 512, 29, 16, 464, True)
    c = one(L.canvas_size(*[F.lit(v) for v in (1, 1, 0, 0, 0, 0)]))
    assert (c.width, c.height, c.overflow) == (256, 64, False)
    assert one(L.choose_bucket(F.lit(65), L.HEIGHTS)) == 96 and one(L.choose_bucket(F.lit(513), L.HEIGHTS)) is None
    assert list(one(L.width_candidates(F.lit(True), F.lit(True)))) == [1024, 896, 768]
    assert len(one(L.coordinates(F.lit(6), F.lit(24)))) == 144
    r = one(L.smart_resize(F.lit(48), F.lit(5000)))
    assert (r.height, r.width) == (64, 4992)  # 1.5 goes to the even 2
    assert one(L.is_valid_canvas(F.lit(256), F.lit(64))) and not one(L.is_valid_canvas(F.lit(250), F.lit(64)))
    assert one(L.as_boolean(F.lit(" Yes "))) and not one(L.as_boolean(F.lit("0")))


def test_schedule(spark):
    f = lambda s, kind: spark.range(1).select(C.lr_factor(F.lit(s), 1000, 100, kind, 0.1)).first()[0]
    assert f(0, "cosine") == 1e-8 and f(50, "linear") == 0.5 and f(100, "cosine") == 1.0 and f(1000, "cosine") == 0.1 and f(550, "linear") == 0.5
    phase = lambda s: spark.range(1).select(C.curriculum(F.lit(s)).alias("p")).first().p.phase
    assert [phase(s) for s in (0, 49_999, 50_000, 100_000)] == [1, 1, 2, 3]
    df = spark.range(3)
    assert [r.id for r in C.recycled(df, 7, "id").orderBy("id").collect()] == [0, 0, 0, 1, 1, 2, 2] and C.recycled(df.where("false"), 3, "id").count() == 0


LINES = ['{"id": "a", "text": "one"}', "", "not json", '{"id": "", "content": ["x", "y"], "category": ["s", "t"]}', '{"doc_id": "d", "text": 5, "body": "b"}', '{"text": [""], "abstract": "abs", "id": null, "doc_id": "e"}']


def test_policies(spark):
    df = spark.createDataFrame([("f", k, line) for k, line in enumerate(LINES)] + [("g", 0, LINES[0])], "source_file string, line_no int, line string")
    n = lambda policy: R.parsed(df, policy=policy).count()
    assert n("skip") == 5 and n("count") == 6 and n("fail_file") == 2
    got = [(r.doc_id, r.subject, r.text) for r in R.picked(R.parsed(df.where("source_file = 'f'"))).orderBy("line_no").collect()]
    assert got[0] == ("a", "", "one") and got[1][1:] == ("s", "x\ny") and len(got[1][0]) == 12 and got[2] == ("d", "", "b") and got[3] == ("e", "", "abs")
    with pytest.raises(ValueError):
        n("other")


def test_one_value_and_nothing_after_it(spark):
    good = ['{"a": 1}', " [1, 2] ", '"x"', "null", "3"]
    bad = ['{"a": 1},', '{"a": 1} x', "{} {}", "{}, {}", "1],[2", '1},{"v":2', "", "{", "tru"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(R.strict_json(F.col("t")).isNotNull()).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_files(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES))
    with gzip.open(tmp_path / "in" / "deep" / "b.jsonl.gz", "wt") as f:
        f.write(LINES[0] + "\n")
    lines = R.read_lines(spark, str(tmp_path / "in"))
    assert lines.count() == 7
    (tmp_path / "w.json").write_text(json.dumps({"meta": 1, "records": [{"text": "a"}, {"text": "b"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"document": {"text": "deep"}}, 3]))
    got = R.exploded(spark, str(tmp_path / "w.json"))
    assert [r[0] for r in got.select(R.text_field(F.col("record"), "text")).collect()] == ["a", "b"]
    got = R.exploded(spark, str(tmp_path / "l.json")).select(R.nested_field(F.col("record"), "missing", "document.text")).collect()
    assert [r[0] for r in got] == ["deep", None]
    assert R.row_at(spark.range(5), "id", -2).first().id == 3 and R.row_at(spark.range(5), "id", 1).first().id == 1
    assert abs(R.estimated_rows(spark, str(tmp_path / "in" / "a.jsonl")) - 6) <= 1


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("a", "é", "s", 1, "train"), ("b", "t", None, 0, "val")], "i string, t string, s string, f int, split string")
    K.write_shards(pages, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.i, r.t, r.split) for r in back.collect()} == {("a", "é", "train"), ("b", "t", "val")}
    rolled = D.rolled_shards(pages.withColumn("line", F.col("t")), "line", "i", 1).join(pages.select(F.col("i").alias("k"), F.col("t").alias("line")), "k")
    K.write_rolled(rolled, str(tmp_path / "rolled"))
    assert spark.read.text(str(tmp_path / "rolled")).count() == 2
    assert K.preview(spark.range(1000).withColumnRenamed("id", "k"), "k", 5, 0.5).count() == 5
    chat = K.image_chat(spark.createDataFrame([("p/1", "text")], "id string, target_text string")).first()
    assert chat.images == ["images/p_1.png"] and chat.messages[1].content == "text"
    K.write_rejects(spark.createDataFrame([("x", "malformed"), ("y", None)], "line string, reject_reason string"), str(tmp_path / "rejects"))
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "doc_id int, text string"
    run = lambda: I.ingest(I.first_copy_stream(I.document_stream(spark, source, schema)).select("doc_id", "sha1"), out, mark).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "a "), (3, "b"), (4, None)], schema).coalesce(1).write.parquet(source)
    run()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(5, "b"), (6, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 3


def test_materialized_tables(spark):
    df = materialize(spark.range(10).where("id > 3"), "t")
    assert df.count() == 6 and materialize(df.where("false"), "empty").count() == 0


def test_release(spark):
    df = materialize(spark.range(10), "gone")
    (file, *_) = df.inputFiles()
    release(spark)
    assert not os.path.exists(file.removeprefix("file://")) and materialize(spark.range(3), "again").count() == 3
