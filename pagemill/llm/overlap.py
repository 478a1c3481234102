"""Problem 1: pages of the evaluation splits that are, whole or nearly whole, in a page of the training split.

A rolling hash runs over a page's words in windows of three, which are the triples that define the case. Where it is
divisible by the mean chunk length a chunk ends (and where the chunk would become longer than its bound), so chunks
depend on the content only. For the overlap fractions the digests of all chunks of one cutting are joined across the
splits and the lengths of shared chunks summed. A chunk of several words is too coarse to find every pair: with a word
changed here and there, as a share of 0.7 allows, no chunk may be left. So pairs are found by the finest chunks,
the windows of the same rolling hash: each evaluation page's windows are joined with the training pages' by their
digests, only as many, and the rarest, as it takes to meet every page that can reach the share (``rare``); then
the pairs are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.pairs import MAPS, exact_overlaps, may_hold, set_bitmaps, with_pages
from pagemill.llm.rare import Counters, overlapping
from pagemill.llm.words import Batch, mix
from pagemill.session import materialize, ship

_LENGTH_BITS = 6
LONGEST = (1 << _LENGTH_BITS) - 1  # words of a chunk
_WINDOW = 3


def chunk_digests(batch: Batch, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, lengths in words, texts as positions in the batch) of all chunks; every word is in one chunk.

    A digest is a hash of the chunk's words with the length in its low bits.
    """
    h = batch.hashes
    rolled = mix(h * np.uint64(3) + np.roll(h, 1) * np.uint64(5) + np.roll(h, 2) * np.uint64(7))
    place = np.arange(len(h)) - np.repeat(batch.starts[:-1], batch.counts)
    cut = (rolled % np.uint64(mean) == 0) & (place >= _WINDOW - 1)
    cut[batch.starts[1:] - 1] = True
    ends = np.flatnonzero(cut) + 1
    lengths = np.diff(ends, prepend=0)
    if lengths.max(initial=0) > LONGEST:  # the bound: further cuts, counted from the last natural one
        begins = np.repeat(ends - lengths, -(-lengths // LONGEST))
        nth = np.arange(len(begins)) - np.repeat(np.cumsum(-(-lengths // LONGEST)) - (-(-lengths // LONGEST)), -(-lengths // LONGEST))
        begins = begins + nth * LONGEST
        ends = np.append(begins[1:], len(h))
        lengths = ends - begins
    begins = ends - lengths
    inside = (np.arange(len(h)) - np.repeat(begins, lengths) + 1).astype(np.uint64)
    digest = mix(np.add.reduceat(mix(h + inside * np.uint64(0x9E3779B97F4A7C15)), begins) + lengths.astype(np.uint64))
    digest = (digest & ~np.uint64(LONGEST)) | lengths.astype(np.uint64)
    return digest, lengths, np.searchsorted(batch.starts, begins, side="right") - 1


def _source(pages: DataFrame, id_col: str, split_col: str, text_col: str, train: str, evaluation: list[str]) -> DataFrame:
    source = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{split_col}`").alias("split"), (F.col(f"`{split_col}`") == train).alias("train"), F.col(f"`{text_col}`").alias("text"))
    return source.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("split").isin([train, *evaluation]))


def keyed(source: DataFrame, width: int, least_words: int) -> DataFrame:
    """id, split, train, key, n (windows) and their bitmap of the pages that count; beside them, in rows with a part, the training windows' counters."""
    ship(source.sparkSession)
    schema = "id string, split string, train boolean, key bigint, n int, " + ", ".join(f"{m} bigint" for m in MAPS) + ", part int, cells binary"
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * len(MAPS), pa.int32(), pa.binary()]
    names = ["id", "split", "train", "key", "n", *MAPS, "part", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, met = Counters(), set()
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                part = big.slice(at, 1024)
                batch = Batch(part.column(3).to_pylist(), max(least_words, width))
                if not len(batch):
                    continue
                grams, starts = batch.shingles(width)
                rows, keys = pa.array(batch.rows), pa.array(batch.text_keys().view(np.int64))
                roles = part.column(2).take(rows)
                sets = [np.unique(grams[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                for key, train, own in zip(keys.to_pylist(), roles.to_pylist(), sets):
                    if train and key not in met:
                        met.add(key)
                        counters.add(own)
                maps = set_bitmaps(sets).view(np.int64)
                known = [part.column(0).take(rows), part.column(1).take(rows), roles, keys, pa.array([len(x) for x in sets], pa.int32()), *[pa.array(np.ascontiguousarray(maps[:, w])) for w in range(len(MAPS))]]
                yield pa.RecordBatch.from_arrays([*known, *[pa.nulls(len(rows), k) for k in kinds[-2:]]], names=names)
        for k, cells in counters.parts():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in kinds[:-2]], pa.array([k], pa.int32()), pa.array([cells], pa.binary())], names=names)

    return source.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def chunked(source: DataFrame, mean: int, least_words: int) -> DataFrame:
    """train (boolean), key, chunks (array<bigint>, in order) of the pages that count."""
    ship(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                part = big.slice(at, 1024)
                batch = Batch(part.column(3).to_pylist(), max(least_words, _WINDOW))
                if not len(batch):
                    continue
                digest, _, owner = chunk_digests(batch, mean)
                ends = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(pa.array(batch.rows)), pa.array(batch.text_keys().view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(digest.view(np.int64)))],
                    names=["train", "key", "chunks"],
                )

    return source.mapInArrow(run, "train boolean, key bigint, chunks array<bigint>")


def split_overlaps(
    pages: DataFrame,
    id_col: str = "id",
    split_col: str = "split",
    text_col: str = "target_text",
    train: str = "train",
    evaluation: tuple[str, ...] = ("val", "test"),
    width: int = 3,
    least_words: int = 20,
    containment: float = 0.7,
    mean_chunk: int = 4,
    more: float = 0.05,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, split, train, key), (fractions: key, overlap), (pairs of keys: a evaluation, b training, containment).

    ``overlap`` is the share of an evaluation text's words in chunks that also occur in the training split, whichever
    page they are in (the page itself, if it was delivered in both splits). A pair comes out when at least
    ``containment`` of the evaluation page's distinct windows are in the training page: every such pair, up to
    collisions of 64-bit hashes. Pages with null id, text or split, of other splits, or of too few words are left out;
    a page delivered again counts once; equal texts share a key; an empty table gives empty results; other columns
    are not read.
    """
    source = _source(pages, id_col, split_col, text_col, train, list(evaluation))
    rows = materialize(keyed(source, width, least_words), "overlap-keys")
    pages_kept = rows.where("part is null")
    members = pages_kept.select("id", "split", "train", "key").distinct()
    counted = rows.where("part is not null").select("part", "cells", "task")
    candidates = overlapping(source.where("not train").select("text"), source.where("train").select("text"), counted, width, least_words, containment, more)
    candidates = materialize(may_hold(candidates, pages_kept.select("key", "n", *MAPS), containment), "overlap-close")
    exact = exact_overlaps(candidates, members, pages, id_col, text_col, width)
    pairs = exact.select("a", "b", (F.col("n_both") / F.col("n_a")).alias("containment")).where(F.col("n_both") >= F.ceil(F.round(containment * F.col("n_a"), 6)))
    texts = members.groupBy("key").agg(F.max("train").alias("t"), F.min("train").alias("e"))
    same = texts.where("t and not e").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("containment"))
    return members, chunk_fractions(chunked(source, mean_chunk, least_words)), materialize(pairs.union(same), "overlap-pairs")


def chunk_fractions(rows: DataFrame) -> DataFrame:
    """(key, overlap) of the evaluation texts of ``chunked``; nothing runs before it is read."""
    chunks = rows.dropDuplicates(["key", "train"]).select("key", "train", F.explode("chunks").alias("digest"))
    there = chunks.where("train").select("digest").distinct().withColumn("there", F.lit(True))
    asked = chunks.where("not train").groupBy("key", "digest").agg(F.count("*").alias("n"))
    words = F.col("n") * F.col("digest").bitwiseAND(F.lit(LONGEST))
    return asked.join(there, "digest", "left").groupBy("key").agg((F.sum(F.when(F.col("there"), words).otherwise(0)) / F.sum(words)).alias("overlap"))


def page_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of keys as pairs of pages: evaluation id and split, training id."""
    asked = members.where("not train").select(F.col("key").alias("a"), "id", F.col("split").alias("eval_split"))
    there = members.where("train").select(F.col("key").alias("b"), "id")
    return with_pages(pairs, asked, there).where("id_a <> id_b").select(F.col("id_a").alias("eval_id"), "eval_split", F.col("id_b").alias("train_id"), "containment")


def report(pages: DataFrame, members: DataFrame, fractions: DataFrame, pairs: DataFrame, id_col: str = "id", doc_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row for each evaluation split, source and doc_id with overlaps: pages, pairs and the greatest overlap fraction.

    A null source or doc_id is a value of its own; a page that was delivered with several takes the least.
    """
    found = page_pairs(members, pairs).groupBy("eval_id", "eval_split").agg(F.countDistinct("train_id").alias("n_pairs"))
    share = members.where("not train").join(fractions, "key").groupBy(F.col("id").alias("eval_id")).agg(F.max("overlap").alias("overlap"))
    labels = pages.groupBy(F.col(f"`{id_col}`").cast("string").alias("eval_id")).agg(F.min(f"`{doc_col}`").alias("doc_id"), F.min(f"`{source_col}`").alias("source"))
    rows = found.join(share, "eval_id", "left").join(labels, "eval_id", "left")
    return rows.groupBy(F.col("eval_split").alias("split"), "source", "doc_id").agg(F.countDistinct("eval_id").alias("n_pages"), F.sum("n_pairs").alias("n_pairs"), F.max("overlap").alias("most_overlap"))
