"""Pairs of texts: their exact check, and from texts to pages without gathering a hot text's pages in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.narrow import narrowed
from pagemill.llm.words import Batch
from pagemill.session import materialize, ship


_BITMAP = 16  # 64-bit words of a set's bitmap
MAPS = [f"m{w}" for w in range(_BITMAP)]


def set_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``_BITMAP`` words for each set of hashes: a bit for each hash, at ten of its bits."""
    out = np.zeros((len(sets), _BITMAP), dtype=np.uint64)
    for row, own in zip(out, sets):
        np.bitwise_or.at(row, (own & np.uint64(_BITMAP - 1)).astype(np.int64), np.uint64(1) << ((own >> np.uint64(4)) & np.uint64(63)))
    return out


def may_hold(pairs: DataFrame, maps: DataFrame, share: float) -> DataFrame:
    """Of ``pairs`` (a, b) those where b may hold ``share`` of the set of a; none that does is lost.

    ``maps``: (key, n, *MAPS). At most as many of a's hashes are in b as bits of a are set in b's bitmap, and those
    that share a bit of a with another one.
    """
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = narrowed(maps, "key", needed, "key").dropDuplicates(["key"])
    left = wanted.select(F.col("key").alias("a"), "n", *[F.col(m).alias(f"l{m}") for m in MAPS])
    right = wanted.select(F.col("key").alias("b"), *MAPS)
    alone = sum((F.bit_count(F.col(f"l{m}")) for m in MAPS), F.lit(0))
    both = sum((F.bit_count(F.col(f"l{m}").bitwiseAND(F.col(m))) for m in MAPS), F.lit(0))
    return pairs.join(left, "a").join(right, "b").where(both + F.col("n") - alone >= F.ceil(F.round(share * F.col("n"), 6))).select("a", "b")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """key, grams (array<bigint>, distinct) of (key, text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                part = big.slice(at, 1024)
                batch = Batch(part.column(1).to_pylist(), width)
                grams, starts = batch.shingles(width)
                sets = [np.unique(grams[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                ends = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(s) for s in sets], out=ends[1:])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(batch.rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "grams"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, grams array<bigint>")


def stand_ins(keys: DataFrame, members: DataFrame, pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key) of one page for each of the ``keys`` (key); of the pages' texts only those wanted are shuffled."""
    stand = materialize(members.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")), "stand-ins")
    texts = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return narrowed(texts, "id", stand, "id").join(stand, "id")


def exact_overlaps(pairs: DataFrame, members: DataFrame, pages: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``pairs`` (a, b: keys) with n_a, n_b and n_both, the sizes of their shingle sets and of what these share.

    One page stands for each key. The set of a travels with the pair to that of b; b's sets are moved once.
    """
    wanted = stand_ins(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), members, pages, id_col, text_col)
    sets = materialize(shingle_sets(wanted, width).dropDuplicates(["key"]), "shingle-sets")
    left = sets.join(pairs.select(F.col("a").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.size("grams_a").alias("n_a"), F.size("grams_b").alias("n_b"), F.size(F.array_intersect("grams_a", "grams_b")).alias("n_both"))


def _blocks(members: DataFrame, key: str, block: int) -> DataFrame:
    """``members`` with ``own``, the block of its key that a row is in, and ``blocks``, how many the key has (about ``block`` rows each)."""
    size = members.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return members.join(size, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _each(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def with_pages(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int = 2000) -> DataFrame:
    """``pairs`` (a, b, ...), a table, with the rows of ``left`` (a, id, ...) and ``right`` (b, id, ...), whose ids become id_a and id_b.

    Many pages of one text are many blocks: no task meets more than a block of each side for one pair.
    """
    left, right = (_blocks(narrowed(df, k, pairs, k), k, block) for df, k in ((left, "a"), (right, "b")))
    n_left, n_right = (df.select(k, F.col("blocks").alias(n)).distinct() for df, k, n in ((left, "a", "n_left"), (right, "b", "n_right")))
    cells = pairs.join(n_left, "a").join(n_right, "b").withColumn("i", _each("n_left")).withColumn("j", _each("n_right")).drop("n_left", "n_right")
    left = cells.join(left.withColumnsRenamed({"id": "id_a", "own": "i"}).drop("blocks"), ["a", "i"])
    right = cells.select("a", "b", "i", "j").join(right.withColumnsRenamed({"id": "id_b", "own": "j"}).drop("blocks"), ["b", "j"])
    return left.join(right, ["a", "b", "i", "j"]).drop("i", "j")


def pairs_within(members: DataFrame, block: int = 2000) -> DataFrame:
    """(id_a, id_b) of all ids of the same root, id_a < id_b; ``members``: (id, root).

    A large group is cut into blocks by a hash, and a task pairs two blocks.
    """
    shared = members.groupBy("root").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("root")
    ids = _blocks(members.join(shared, "root", "left_semi").select("root", "id").distinct(), "root", block)
    both = ids.withColumn("other", _each("blocks")).select("root", "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    left = both.where("own = i").select("root", "i", "j", F.col("id").alias("x"))
    right = both.where("own = j").select("root", "i", "j", F.col("id").alias("y"))
    met = left.join(right, ["root", "i", "j"]).where("x <> y and (i < j or x < y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
