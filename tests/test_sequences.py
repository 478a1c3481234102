import pytest
from pyspark.sql import functions as F

from pagemill.functions.udfs import FONTS, LAYOUTS, TASK_WEIGHTS, boundaries_of, build_task, sample_style, sample_task, stable_seed_of, style_of
from pagemill.operators import sequences as S

SP = S.Special(pad=151643, eos=151645, vision_start=151652, vision_end=151653, image_pad=151655)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ids(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def test_prefix(spark):
    got = one(spark, S.vision_prefix(F.lit(512), SP))
    assert len(got) == 514 and got[0] == 151652 and got[-1] == 151653 and set(got[1:-1]) == {151655}


def test_full_ocr_masks_the_image(spark):
    got = one(spark, S.task_sequence(F.lit("full_ocr"), F.lit(False), ids(9), ids(1, 2, 3), F.lit(4), SP))
    assert list(got.labels) == [-100] * 6 + [1, 2, 3, 151645] and got.ids[-1] == 151645


def test_replay_masks_nothing(spark):
    got = one(spark, S.task_sequence(F.lit("text_replay"), F.lit(True), ids(9), ids(1, 2, 3), F.lit(4), SP))
    assert list(got.ids) == list(got.labels) == [1, 2, 3, 151645]


def test_context_comes_first(spark):
    got = one(spark, S.task_sequence(F.lit("span_reconstruction"), F.lit(False), ids(8, 9), ids(1), F.lit(1), SP))
    assert list(got.ids) == [8, 9, 151652, 151655, 151653, 1, 151645] and list(got.labels) == [-100] * 5 + [1, 151645]


def test_truncation(spark):
    seq = S.pair(ids(7, 7), ids(1, 2, 3))
    cut = one(spark, S.truncate(seq, 4))
    assert list(cut.ids) == [7, 7, 1, 2]
    kept = one(spark, S.image_answer(ids(1, 2, 3, 4, 5, 6, 7, 8), F.lit(2), 9))
    assert list(kept.ids) == [5, 7, 7, 6, 1, 2, 3, 4, 1] and one(spark, S.image_answer(ids(1, 2, 3, 4), F.lit(2), 8)) is None


def test_alignment(spark):
    for n, ok in ((512, True), (511, False), (513, False)):
        assert one(spark, S.aligned(S.vision_prefix(F.lit(n)), F.lit(16), F.lit(32))) is ok


def test_chat(spark):
    encode = lambda c: S.code_points(c, 1000)
    rows = [
        (1, [("user", "<image>\nRead it"), ("assistant", "Yes")], 2),
        (2, [("system", "x"), ("user", "Hi"), ("assistant", " ")], 2),  # the system turn takes the first place: no image
        (3, None, 0),
        (4, [("user", None), ("assistant", "A"), ("tool", "t")], 0),
    ]
    df = spark.createDataFrame(rows, "k int, messages array<struct<role:string,content:string>>, n int")
    got = {r.k: r.s for r in df.select("k", S.chat_sequence(F.col("messages"), F.col("n"), encode).alias("s")).collect()}
    head = len("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n")
    assert len(got[1].ids) == head + 17 + 4 + 7 + 11 + 22 + 3 + 11 and [x for x in got[1].labels if x != -100] == [ord(c) for c in "Yes"]
    assert 7 in got[1].ids and len(got[2].ids) == head + 17 + 2 + 11 and got[2].ids.count(7) == 0
    assert len(got[3].ids) == head and [x for x in got[4].labels if x != -100] == [ord("A")]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 2, 3]), (0, [4], [-100]), (1, [5], [5])], "batch int, ids array<bigint>, labels array<bigint>")
    got = sorted((list(r.input_ids), list(r.padded_labels), list(r.attention_mask)) for r in S.pad_batches(df).collect())
    assert got == [([1, 2, 3], [1, 2, 3], [1, 1, 1]), ([4, 0, 0], [-100, -100, -100], [1, 0, 0]), ([5], [5], [1])]


def test_placeholders(spark):
    f = lambda t, *n: one(spark, S.expand_placeholders(F.lit(t), F.array(*map(F.lit, n))))
    assert f("a<image>b<image>", 2, 1) == "a<image><image>b<image>" and f("a<image>", 1, 2) is None


def test_first_answer(spark):
    df = spark.createDataFrame([([("assistant", " a "), ("assistant", "b")],), ([("assistant", ""), ("assistant", "b")],), ([],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(S.first_answer(F.col("m"))).collect()] == ["a", None, None, None]


TEXT = "One sentence is here. Another one follows it now.\nA third line stands alone! And so on it goes for a while. " * 6


@pytest.mark.parametrize("name", list(TASK_WEIGHTS))
def test_tasks(name):
    import random

    for seed in range(40):
        t = build_task(name, TEXT, random.Random(seed))
        if t["task_type"] == "optical_continuation":
            assert t["target_text"] == t["suffix_text"] and len(t["suffix_text"]) >= 10
        elif t["task_type"] == "span_reconstruction":
            assert t["target_text"] == t["visual_text"] and t["visual_text"] in TEXT
        else:
            assert t["target_text"] == TEXT
    assert build_task(name, "short", random.Random(1))["task_type"] in ("full_ocr", "text_replay")


def test_sampled_tasks_are_reproducible(spark):
    df = spark.createDataFrame([(f"p{k}", TEXT) for k in range(400)] + [(None, None)], "id string, t string")
    run = lambda d: sorted(map(str, d.select("id", sample_task()(F.col("id"), F.col("t"), F.lit(1)).alias("x")).collect()))
    assert run(df) == run(df.repartition(5))
    kinds = df.select(sample_task()(F.col("id"), F.col("t"), F.lit(1)).alias("x")).groupBy("x.task_type").count().collect()
    assert {r.task_type for r in kinds} == set(TASK_WEIGHTS)


def test_styles(spark):
    assert style_of("a", 0) == style_of("a", 0) != style_of("a", 1)
    for k in range(200):
        s = style_of(str(k), 0)
        assert s[0] in LAYOUTS and s[1] in FONTS[LAYOUTS[s[0]][3]] and 18 <= s[2] <= 34 and 70 <= s[15] <= 100
    got = spark.range(50).select(sample_style()(F.col("id").cast("string"), F.lit(0)).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [style_of(str(k), 0) for k in range(50)]


def test_seeds_and_boundaries():
    assert stable_seed_of("a", 1) != stable_seed_of("a1") and 0 <= stable_seed_of("x") < 2**64
    assert boundaries_of("a. b\nc") == [0, 2, 5, 6] and boundaries_of("") == [0]
