"""Problem 4: groups of pages that are the same but for small edits.

One pass over the texts gives each page a key of its word sequence, MinHash bands and an odd sketch: the MinHash
samples folded into a parity bitmap, so that the population count of two bitmaps' XOR estimates the similarity.
Pages in one band bucket are compared with the bucket's least key first (a star, linear in the bucket); groups
follow from the pairs that pass. Then, for every bucket that still holds several groups, members of different groups
are compared too: all pairs in a small bucket, while the members of a larger one (pages that share stock wording, say)
look for each other by their rarest windows, which misses no alike pair and does not meet by what all of them share.
So no pair that shares a bucket is lost and no bucket emits all its pairs. Candidates are verified by the sketches, then
exactly by their shingle sets. The links found so are enough for the groups but are not all links; ``link_counts``
compares all texts of a group, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.narrow import narrowed
from pagemill.llm.pairs import exact_overlaps, shingle_sets, stand_ins
from pagemill.llm.rare import count_windows, overlapping
from pagemill.llm.words import Batch, mix
from pagemill.session import materialize, ship

_WORDS = 8  # 64-bit words of an odd sketch


def _parameters(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    k = bands * rows
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, k, dtype=np.uint64)


def minhash(batch: Batch, width: int, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima for each text of the batch (every text has at least one shingle)."""
    hashes, starts = batch.shingles(width)
    out = np.empty((len(batch), len(multipliers)), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(multipliers, offsets)):
        out[:, i] = np.minimum.reduceat(((hashes * a + b) >> np.uint64(32)).astype(np.uint32), starts[:-1])
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(samples), bands), dtype=np.uint64)
    for j in range(bands):
        key = np.full(len(samples), j + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, j * rows + r])
        out[:, j] = key
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of 512 bits, as eight words: each sample (its number and value) flips one bit."""
    n, k = samples.shape
    bits = mix(samples + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(64 * _WORDS)
    out = np.zeros((n, _WORDS), dtype=np.uint64)
    flip = np.uint64(1) << (bits & np.uint64(63))
    word = bits >> np.uint64(6)
    for w in range(_WORDS):
        out[:, w] = np.bitwise_xor.reduce(np.where(word == w, flip, np.uint64(0)), axis=1)
    return out


def most_differing_bits(similarity: float, samples: int) -> int:
    """The XOR population count that corresponds to a similarity."""
    n = 64 * _WORDS
    return math.ceil(n / 2 * (1 - (1 - 2 / n) ** (2 * samples * (1 - similarity))))


def signatures(pages: DataFrame, id_col: str, text_col: str, width: int, least_words: int, bands: int, rows: int) -> DataFrame:
    """id, key (bigint, of the word sequence), bands (array<bigint>), s0..s7 (the odd sketch); pages of too few words are left out."""
    ship(pages.sparkSession)
    multipliers, offsets = _parameters(bands, rows)
    names = ["id", "key", "bands", *[f"s{w}" for w in range(_WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                part = big.slice(at, 1024)
                batch = Batch(part.column(1).to_pylist(), max(least_words, width))
                if not len(batch):
                    continue
                samples = minhash(batch, width, multipliers, offsets)
                sketch = odd_sketches(samples).view(np.int64)
                flat = pa.array(band_keys(samples, bands, rows).view(np.int64).ravel())
                ends = pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(batch.rows)),
                        pa.array(batch.text_keys().view(np.int64)),
                        pa.ListArray.from_arrays(ends, flat),
                        *[pa.array(np.ascontiguousarray(sketch[:, w])) for w in range(_WORDS)],
                    ],
                    names=names,
                )

    schema = "id string, key bigint, bands array<bigint>, " + ", ".join(f"s{w} bigint" for w in range(_WORDS))
    return pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null").mapInArrow(run, schema)


def near_duplicates(
    pages: DataFrame,
    id_col: str = "id",
    text_col: str = "target_text",
    width: int = 3,
    least_words: int = 20,
    similarity: float = 0.6,
    bands: int = 40,
    rows: int = 4,
    sketch_slack: float = 0.25,
    small_bucket: int = 64,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(members: id, key, root), (links: a, b, similarity of keys): every page and the group it is of.

    A key stands for all pages of the same words. Pages with a null id, a null, empty or too short text are left
    out; a page delivered again counts once; equal texts are one key and so always one group; an empty table gives
    empty results; other columns are not read. ``similarity`` is the share of common shingles among all of two pages.
    Bands meet an alike pair with a high probability; with ``exact`` all texts look for each other by their
    rarest windows as well and no sketch decides, so that no alike pair is missed.
    """
    signed = materialize(signatures(pages, id_col, text_col, width, least_words, bands, rows), "signatures")
    members = signed.select("id", "key").distinct()

    exploded = signed.select("key", F.explode("bands").alias("band")).repartition("band")  # shuffled once, read twice
    shared = exploded.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("band", "lead")
    buckets = materialize(exploded.join(shared.hint("merge"), "band").distinct(), "buckets")

    sketch = [F.col(f"s{w}") for w in range(_WORDS)]
    most = most_differing_bits(similarity - sketch_slack, bands * rows)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Odd sketches first, then the sets."""
        close = pairs
        if not exact:
            needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
            sketches = signed.select("key", *sketch).join(needed, "key", "left_semi").dropDuplicates(["key"])
            left = sketches.select(F.col("key").alias("a"), *[c.alias(f"l{w}") for w, c in enumerate(sketch)])
            right = sketches.select(F.col("key").alias("b"), *[c.alias(f"r{w}") for w, c in enumerate(sketch)])
            differing = sum((F.bit_count(F.col(f"l{w}").bitwiseXOR(F.col(f"r{w}"))) for w in range(_WORDS)), F.lit(0))
            close = materialize(pairs.join(left, "a").join(right, "b").where(differing <= most).select("a", "b"), f"{name}-close")
        overlap = exact_overlaps(close, members, pages, id_col, text_col, width)
        share = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
        return materialize(overlap.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity), name)

    stars = materialize(buckets.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct(), "stars")
    links = verified(stars, "links")
    groups = connected_components(links.select("a", "b"), "groups")

    # Members of one bucket that are still in different groups.
    placed = buckets.join(groups.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    apart = materialize(placed.join(mixed, "band"), "apart")
    small, large = apart.where(F.col("n") <= small_bucket), apart.where(F.col("n") > small_bucket).select("key").distinct()
    other = small.select("band", F.col("key").alias("b"), F.col("root").alias("root_b"))
    across = small.withColumnRenamed("key", "a").join(other, "band").where("a < b and root <> root_b").select("a", "b").distinct()
    across = materialize(across.join(stars, ["a", "b"], "left_anti"), "across")
    if exact:
        large = signed.select("key").distinct()
    if large.limit(1).count():
        texts = materialize(stand_ins(large, members, pages, id_col, text_col).select("text"), "large-buckets")
        counted = materialize(count_windows(texts, width, least_words), "window-counts")
        met = overlapping(texts, texts, counted, width, least_words, similarity)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        of = groups.select(F.col("node").alias("key"), "root")
        met = met.join(of.withColumnsRenamed({"key": "a", "root": "x"}), "a", "left").join(of.withColumnsRenamed({"key": "b", "root": "y"}), "b", "left")
        met = met.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b")
        across = materialize(across.union(met).distinct().join(stars, ["a", "b"], "left_anti"), "across-all")
    more = verified(across, "more-links")
    links = links.union(more)
    if more.limit(1).count():
        groups = connected_components(links.select("a", "b"), "groups-all")
    members = members.join(groups.withColumnRenamed("node", "key"), "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))
    return members, links


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets are alike, each with each, exactly: incidence matrices of a slice of the shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column, keep = np.cumsum(shared) - 1, shared[gram]
    owner, gram = owner[keep], column[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(gram, [low, low + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[owner[a:b], gram[a:b] - low] = 1
        both += held @ held.T
    size = np.array([len(x) for x in sets])
    return both / (size[:, None] + size[None, :] - both) >= similarity


def link_counts(members: DataFrame, pages: DataFrame, id_col: str = "id", text_col: str = "target_text", width: int = 3, similarity: float = 0.6, block: int = 256) -> DataFrame:
    """(key, n_links) of the texts of groups: with how many other texts each is alike, all texts of a group being compared.

    Large groups are cut into blocks by a hash; a task compares two blocks and gives counts, never pairs.
    """
    texts = members.select("root", "key").distinct()
    parts = texts.groupBy("root").agg(F.ceil(F.count("*") / block).alias("parts"), F.count("*").alias("n")).where("n > 1").select("root", "parts")
    placed = materialize(texts.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts"))), "placed")
    stand = materialize(members.join(placed.select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")), "link-stand-ins")
    source = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    sets = shingle_sets(narrowed(source, "id", stand, "id").join(stand, "id"), width).dropDuplicates(["key"])
    pairs = placed.join(sets, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    pairs = pairs.select("root", "key", "own", "grams", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(table: pa.Table) -> pa.Table:
        alike = _alike([np.asarray(x, dtype=np.int64) for x in table.column("grams").to_pylist()], similarity)
        np.fill_diagonal(alike, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            own = table.column("own").to_numpy()
            alike &= own[:, None] != own[None, :]
        return pa.table({"key": table.column("key"), "n": pa.array(alike.sum(axis=1).astype(np.int64))})

    return pairs.groupBy("root", "i", "j").applyInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n_links"))


def group_report(members: DataFrame, links: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row for each page of a group: id, group_id (the least id), pages of the group and links of the page's text.

    ``counts`` (key, n_links) has the links of all pairs; without it only those of ``links`` count, which span the groups.
    """
    ends = counts if counts is not None else links.select(F.col("a").alias("key")).union(links.select("b")).groupBy("key").agg(F.count("*").alias("n_links"))
    groups = members.groupBy("root").agg(F.min("id").alias("group_id"), F.countDistinct("id").alias("n_pages")).where("n_pages > 1")
    return members.join(groups, "root").join(ends, "key", "left").select("id", "group_id", "n_pages", F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct()
