import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import neardup, overlap
from pagemill.llm.pairs import pairs_within, with_pages
from pagemill.llm.components import connected_components
from pagemill.llm.words import Batch, words_of

from . import pages

SCHEMA = "id string, split string, target_text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"key": F.lit("clash"), "text": F.lit(1), "band": F.lit(None).cast("int"), "root": F.lit("r"), "train": F.lit(0)})


def test_words():
    assert words_of("So­ft hy​phen, ﬁne_1 É ２!") == ["soft", "hyphen", "fine", "1", "é", "2"]
    assert words_of(None) == words_of("") == []
    for _, _, t in pages.make():
        assert words_of(t) == pages.words(t)


def test_shingles_stay_inside_texts():
    batch = Batch(["a b c d", "x", None, "a b c"], 1)
    grams, starts = batch.shingles(3)
    assert list(np.diff(starts)) == [2, 0, 1] and grams[0] == grams[2] and len(set(grams.tolist())) == 2
    assert len(Batch([], 1).shingles(3)[0]) == 0 and len(Batch(["a"], 1).shingles(3)[0]) == 0


def test_odd_sketch_estimates_high_similarities():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**32, (200, 160), dtype=np.uint64)
    for same in (1.0, 0.9, 0.75, 0.6):
        b = np.where(rnd.random(a.shape) < same, a, rnd.integers(0, 2**32, a.shape, dtype=np.uint64))
        bits = [bin(int(x)).count("1") for x in (neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).ravel()]
        mean = np.reshape(bits, (200, -1)).sum(axis=1).mean()
        assert abs(mean - neardup.most_differing_bits(same, 160)) < 4


@pytest.mark.parametrize("seed", [3, 4])
def test_overlaps_are_those_of_all_pairs(spark, seed):
    rows = pages.make(seed)
    members, fractions, pairs = overlap.split_overlaps(frame(spark, rows))
    got = {(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in overlap.page_pairs(members, pairs).collect()}
    assert got == pages.plain_overlaps(rows) and got
    shares = [r.overlap for r in fractions.collect()]
    assert shares and all(0 <= s <= 1 for s in shares)


@pytest.mark.parametrize("even", [True, False])
def test_overlaps_near_the_threshold(spark, even):
    """Single-word edits that leave 0.70 to 0.75 of the triples, evenly spaced or at random, in pages of 20 to 600 words."""
    rnd = pages.random.Random(31)
    rows = []
    for k, n in enumerate([20, 25, 40, 60, 80, 110, 150, 200, 300, 450, 600] * 3):
        words = [f"w{rnd.randrange(9000)}" for _ in range(n)]
        made, whole = list(words), pages.triples(" ".join(words))
        order = [round((j + 0.5) * n / max(1, n // 10)) for j in range(max(1, n // 10))] if even else rnd.sample(range(n), n)
        for j in order:
            tried = [*made[:j], f"x{k}y{j}", *made[j + 1 :]]
            own = pages.triples(" ".join(tried))
            if len(own & whole) >= 0.7 * len(own):
                made = tried
        rows += [(f"t{k}", "train", " ".join(words)), (f"v{k}", ("val", "test")[k % 2], " ".join(made))]
    want = pages.plain_overlaps(rows)
    members, _, pairs = overlap.split_overlaps(frame(spark, rows))
    got = overlap.page_pairs(members, pairs).collect()
    assert {(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in got} == want and len(want) == 33
    assert sum(r.containment <= 0.75 for r in got) >= 20


@pytest.mark.parametrize("seed", [3, 5])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = pages.make(seed)
    members, links = neardup.near_duplicates(frame(spark, rows))
    got = [(r.id_a, r.id_b) for r in pairs_within(members).collect()]
    assert len(got) == len(set(got)) and set(got) == pages.plain_groups(rows)
    report = neardup.group_report(members, links).collect()
    assert {r.id for r in report} == {i for pair in got for i in pair}
    assert len(report) == len({r.id for r in report})


@pytest.mark.parametrize("block", [256, 8])
def test_links_are_counted_over_all_pairs(spark, block):
    rnd = pages.random.Random(17)
    near = pages.text(rnd, 30)
    rows = [(f"b{k:03d}", "val", pages.edited(rnd, near, 3)) for k in range(30)] + [("b-copy", "train", near)] * 2 + pages.make(3, 20)
    df = frame(spark, rows)
    members, links = neardup.near_duplicates(df)
    got = {r.id: r.n_links for r in neardup.group_report(members, links, neardup.link_counts(members, df, block=block)).collect()}
    sets = {tuple(pages.words(t)): pages.triples(t) for _, _, t in rows if pages.triples(t)}
    texts = {i: tuple(pages.words(t)) for i, _, t in rows if i in got}
    want = {i: sum(u != w and len(sets[u] & sets[w]) >= 0.6 * len(sets[u] | sets[w]) for u in sets) for i, w in texts.items()}
    assert got == want and max(want.values()) >= 29


def test_chains_join_groups(spark):
    rnd = pages.random.Random(9)
    first = pages.text(rnd, 12).split(" ")
    fresh = pages.text(rnd, 12).split(" ")
    rows = [(f"c{k}", "train", " ".join(fresh[: 10 * k] + first[10 * k :])) for k in range(8)]
    assert pages.plain_groups(rows) and not pages.plain_groups([rows[0], rows[-1]])
    members, _ = neardup.near_duplicates(frame(spark, rows))
    assert {(r.id_a, r.id_b) for r in pairs_within(members).collect()} == pages.plain_groups(rows)


def test_one_hot_text(spark):
    """A third of all pages is one text; another third are edits of one."""
    rnd = pages.random.Random(11)
    hot, near = pages.text(rnd, 8), pages.text(rnd, 30)
    rows = [(f"a{k:03d}", "train", hot) for k in range(60)] + [(f"b{k:03d}", "val", pages.edited(rnd, near, 3)) for k in range(40)] + [(f"c{k:03d}", "test", pages.text(rnd, 8)) for k in range(40)]
    members, links = neardup.near_duplicates(frame(spark, rows))
    assert {(r.id_a, r.id_b) for r in pairs_within(members).collect()} == pages.plain_groups(rows)
    assert links.count() < 40 * 39 / 2  # the group does not emit all its pairs


def test_empty_tables(spark):
    empty = frame(spark, [])
    members, links = neardup.near_duplicates(empty)
    assert pairs_within(members).count() == 0 and neardup.group_report(members, links).count() == 0
    members, fractions, pairs = overlap.split_overlaps(empty)
    assert overlap.page_pairs(members, pairs).count() == 0 and fractions.count() == 0
    nothing = frame(spark, [(None, None, None), ("a", "val", None), (None, "train", "x " * 40)])
    assert neardup.near_duplicates(nothing)[0].count() == 0


def test_very_long_text(spark):
    rnd = pages.random.Random(2)
    long = pages.text(rnd, 3000)
    rows = [("a", "train", long), ("b", "val", pages.edited(rnd, long, 400)), ("c", "test", "word " * 30_000)]
    members, _ = neardup.near_duplicates(frame(spark, rows))
    assert {(r.id_a, r.id_b) for r in pairs_within(members).collect()} == pages.plain_groups(rows) == {("a", "b")}


def test_components(spark):
    rnd = pages.random.Random(5)
    edges = [(str(rnd.randrange(300)), str(rnd.randrange(300))) for _ in range(170)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = connected_components(spark.createDataFrame([*edges, (None, "1"), ("z", "z"), *edges[:9]], "a string, b string")).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for n in root} | {"z": "z"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("block", [2000, 3])
def test_pages_of_hot_texts_are_paired_in_blocks(spark, block):
    members = spark.createDataFrame([(f"p{k:02d}", k % 2) for k in range(20)] + [("p00", 0), ("alone", 7)], "id string, root bigint")
    want = {(f"p{a:02d}", f"p{b:02d}") for a in range(20) for b in range(a + 1, 20) if a % 2 == b % 2}
    got = [tuple(r) for r in pairs_within(members, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a bigint, b bigint")
    left = spark.createDataFrame([(1, f"l{k}") for k in range(11)] + [(3, "m")], "a bigint, id string")
    right = spark.createDataFrame([(2, f"r{k}") for k in range(8)] + [(4, "s"), (5, "t")], "b bigint, id string")
    got = sorted((r.id_a, r.id_b) for r in with_pages(pairs, left, right, block).collect())
    assert got == sorted([(f"l{a}", f"r{b}") for a in range(11) for b in range(8)] + [("m", "s")])


def plain_fractions(rows, mean):
    """Chunks cut one word after the other, as the definition says."""
    seen = {}
    for i, split, text in rows:
        if pages.triples(text) and split in ("train", "val", "test"):
            batch = Batch([text], 3)
            h = [int(x) for x in batch.hashes]
            chunks, start = [], 0
            for k in range(len(h)):
                rolled = (h[k] * 3 + (h[k - 1] * 5 + h[k - 2] * 7 if k >= 2 else 0)) % 2**64
                cut = k >= 2 and int(overlap.mix(np.array([rolled], dtype=np.uint64))[0]) % mean == 0
                if cut or k + 1 == len(h) or k + 1 - start == overlap.LONGEST:
                    chunks.append(tuple(h[start : k + 1]))
                    start = k + 1
            seen.setdefault(tuple(h), (set(), chunks))[0].add(split)
    there = {c for splits, chunks in seen.values() if "train" in splits for c in chunks}
    return sorted(round(sum(len(c) for c in chunks if c in there) / sum(map(len, chunks)), 9) for splits, chunks in seen.values() if splits - {"train"})


def test_fractions_are_shares_of_words(spark):
    rnd = pages.random.Random(8)
    rows = pages.make(4) + [("few", "val", "so it is " * 50), ("few2", "train", "so it is " * 30), ("same", "test", "word " * 500), ("same2", "train", "word " * 900)]
    rows += [("own", "val", " ".join(f"u{rnd.randrange(10**6)}" for _ in range(400)))]
    _, fractions, _ = overlap.split_overlaps(frame(spark, rows))
    got = sorted(round(r.overlap, 9) for r in fractions.collect())
    assert got == plain_fractions(rows, 4) and got[0] == 0 and got[-1] == 1


def test_pages_of_few_words_or_stock_wording(spark):
    """Six words in all, one of them changed; and pages of stock wording only, in two orders."""
    rnd = pages.random.Random(13)
    stock = [pages.text(rnd, 2) for _ in range(3)]
    rows = []
    for k in range(40):
        words = [f"z{rnd.randrange(6)}" for _ in range(40)]
        rows.append((f"t{k:02d}", "train", " ".join(words)))
        words[rnd.randrange(40)] = "other"
        rows.append((f"v{k:02d}", "val", " ".join(words)))
        rows.append((f"s{k:02d}", ("train", "test")[k % 2], " ".join(rnd.sample(stock, 3))))
    members, _, pairs = overlap.split_overlaps(frame(spark, rows))
    got = {(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in overlap.page_pairs(members, pairs).collect()}
    assert got == pages.plain_overlaps(rows) and len(got) > 400


def test_many_pages_share_a_stock_paragraph(spark):
    """Different pages with one stock paragraph each: buckets of stock wording do not pair their members."""
    rnd = pages.random.Random(21)
    stock = pages.text(rnd, 6)
    rows = [(f"q{k:05d}", "train", stock + " " + " ".join(f"w{rnd.randrange(10**7)}" for _ in range(50))) for k in range(3000)]
    rows += [(f"r{k:05d}", "val", pages.edited(rnd, rows[k][2], 2)) for k in range(60)]
    members, _ = neardup.near_duplicates(frame(spark, rows), small_bucket=16)
    got = {(r.id_a, r.id_b) for r in pairs_within(members).collect()}
    assert got == {(f"q{k:05d}", f"r{k:05d}") for k in range(60)}


def test_exact_groups_miss_nothing(spark):
    rows = pages.make(6)
    members, _ = neardup.near_duplicates(frame(spark, rows), bands=1, rows=8, exact=True)
    assert {(r.id_a, r.id_b) for r in pairs_within(members).collect()} == pages.plain_groups(rows)
