"""Candidates of an exact overlap join: texts that share enough of the rarest windows of one of them.

A window is a run of words under a rolling hash. Of a text with n distinct windows, of which a partner must hold at
least ``need``, any n - need + k windows meet at least k of the partner's. So a text asks by that many of its windows
only, and by the rarest ones, which makes stock wording nobody's way to anybody; no partner is missed, whichever
windows are chosen. How rare a window is comes from a table of 2**22 counters over all texts (a collision can only make
a window look more frequent); a window that very many texts hold is spread over salts, whose number both sides
read off the same counter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.words import Batch
from pagemill.session import materialize, ship

CELLS = 22  # bits: four million counters, one byte each when they are sent to the tasks
_PART = 1 << 16  # counters that travel together
_FAN = 64  # parts of counters that one task adds up
_STEPS = 8  # steps of a counter for each doubling
MOST_BITS = 26  # of the bitmap of asked windows: 8 MB, whatever their number
SALTED = 20_000  # texts with one window that one task should meet at most


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(cells, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)


def _unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cells), dtype=np.uint32)


class Counters:
    """Counts of windows by the leading bits of their hashes, over the texts of one task."""

    def __init__(self):
        self.cells = np.zeros(1 << CELLS, dtype=np.uint32)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        self.held.append(windows >> np.uint64(64 - CELLS))
        self.size += len(windows)
        if self.size > 1 << 21:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.cells += np.bincount(np.concatenate(self.held).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
        self.held, self.size = [], 0

    def parts(self) -> list[tuple[int, bytes]]:
        self.flush()
        table = self.cells.reshape(-1, _PART)
        return [(int(k), _packed(table[k])) for k in np.flatnonzero(table.any(axis=1))]


def count_windows(texts: DataFrame, width: int, least_words: int) -> DataFrame:
    """(part, cells, task) of the windows of ``texts`` (text); a text that a task meets again counts once."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, met = Counters(), set()
        for batch, _ in _tokenised(batches, max(least_words, width)):
            grams, starts = batch.shingles(width)
            for key, a, b in zip(batch.text_keys().tolist(), starts[:-1], starts[1:]):
                if key not in met:
                    met.add(key)
                    counters.add(np.unique(grams[a:b]))
        parts = counters.parts()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["part", "cells"])

    return texts.select("text").mapInArrow(run, "part int, cells binary").withColumn("task", F.spark_partition_id())


def frequencies(counted: DataFrame) -> Broadcast:
    """The counters of all tasks added up, each as a byte on a scale of logarithms: 4 MB, whatever the input.

    ``counted``: (part, cells, task), a table. Parts are added up in groups of ``_FAN`` tasks, level by level.
    """
    spark = counted.sparkSession

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PART, dtype=np.uint64)
        for cells in pdf["cells"]:
            total += _unpacked(cells)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0]], "cells": [_packed(total)]})

    tasks = counted.agg(F.max("task")).first()[0]
    while tasks:
        tasks //= _FAN
        counted = counted.select("part", F.floor(F.col("task") / _FAN).cast("int").alias("task"), "cells").groupBy("part", "task").applyInPandas(add, "part int, task int, cells binary")
    scale = np.zeros((1 << CELLS) // _PART * _PART, dtype=np.uint8)
    for row in counted.select("part", "cells").toLocalIterator():  # 64 parts of 256 KB at most
        cells = _unpacked(row["cells"]).astype(np.float64)
        scale[row["part"] * _PART : (row["part"] + 1) * _PART] = np.minimum(255, np.rint(_STEPS * np.log2(1 + cells)))
    return spark.sparkContext.broadcast(scale.tobytes())


def _tokenised(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[Batch, pa.RecordBatch]]:
    for big in batches:
        for at in range(0, big.num_rows, 1024):
            part = big.slice(at, 1024)
            batch = Batch(part.column(0).to_pylist(), least)
            if len(batch):
                yield batch, part


def _salts(scale: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(np.exp2(scale / _STEPS) / SALTED)).astype(np.int64)


def asked_windows(texts: DataFrame, common: Broadcast, width: int, least_words: int, share: float, more: float) -> DataFrame:
    """(gram, salt, a, need, shared): the windows by which each of ``texts`` (text) looks for partners that hold ``share`` of its windows."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, met = np.frombuffer(common.value, dtype=np.uint8), set()
        for batch, _ in _tokenised(batches, max(least_words, width)):
            grams, starts = batch.shingles(width)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, a, b in zip(batch.text_keys().view(np.int64).tolist(), starts[:-1], starts[1:]):
                if key in met:
                    continue
                met.add(key)
                own = np.unique(grams[a:b])
                n = len(own)
                need = math.ceil(round(share * n, 6))
                shared = min(need, max(1, int(more * n)))
                seen = scale[(own >> np.uint64(64 - CELLS)).astype(np.int64)]
                chosen = np.argsort(seen, kind="stable")[: n - need + shared]
                chosen = chosen[seen[chosen] > 0]  # no text at all holds the others
                times = _salts(seen[chosen])
                size = int(times.sum())
                for column, values in zip(out, (np.repeat(own[chosen], times).view(np.int64), np.concatenate([np.arange(t) for t in times]) if size else np.zeros(0, np.int64), np.full(size, key), np.full(size, need), np.full(size, shared))):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64 if k in (0, 2) else np.int32)) for k, c in enumerate(out)], names=["gram", "salt", "a", "need", "shared"])

    return texts.select("text").mapInArrow(run, "gram bigint, salt int, a bigint, need int, shared int")


def window_bitmap(asked: DataFrame) -> tuple[Broadcast, int]:
    """Which windows are asked by, as a bitmap over the leading bits of their hashes, and the number of these bits."""
    n = asked.count()
    bits = min(MOST_BITS, max(18, (32 * max(n, 1) - 1).bit_length()))
    place = asked.select((F.shiftrightunsigned("gram", 64 - bits) + 1).alias("h"))
    parts = place.groupBy(F.expr("bitmap_bucket_number(h)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
    whole = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most 2,048 rows of 4 KB
        at = (row["part"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)[: len(whole) - at]
    return asked.sparkSession.sparkContext.broadcast(whole.tobytes()), bits


def held_windows(texts: DataFrame, asked: tuple[Broadcast, int], common: Broadcast, width: int, least_words: int) -> DataFrame:
    """(gram, salt, b, n_b): of ``texts`` (text), the windows that may be asked for, and how many the text has."""
    ship(texts.sparkSession)
    marked, bits = asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, bitmap, met = np.frombuffer(common.value, dtype=np.uint8), np.frombuffer(marked.value, dtype=np.uint8), set()
        for batch, _ in _tokenised(batches, max(least_words, width)):
            grams, starts = batch.shingles(width)
            place = (grams >> np.uint64(64 - bits)).astype(np.int64)
            hit = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            found, keys, sizes = [], [], []
            for key, a, b in zip(batch.text_keys().view(np.int64).tolist(), starts[:-1], starts[1:]):
                if key in met:
                    continue
                met.add(key)
                own = np.unique(grams[a:b][hit[a:b]])
                if len(own):
                    found.append(own)
                    keys.append(key)
                    sizes.append(len(np.unique(grams[a:b])))
            if not found:
                continue
            times = [len(x) for x in found]
            windows, key = np.concatenate(found), np.repeat(np.array(keys, dtype=np.int64), times)
            salt = key.view(np.uint64) % _salts(scale[(windows >> np.uint64(64 - CELLS)).astype(np.int64)]).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(windows.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(key), pa.array(np.repeat(np.array(sizes, dtype=np.int32), times))], names=["gram", "salt", "b", "n_b"])

    return texts.select("text").mapInArrow(run, "gram bigint, salt int, b bigint, n_b int")


def overlapping(asking: DataFrame, holding: DataFrame, counted: DataFrame, width: int, least_words: int, share: float, more: float = 0.05) -> DataFrame:
    """(a, b), a table: all pairs of different texts where b may hold ``share`` of the distinct windows of a.

    ``asking`` and ``holding``: (text); ``counted``: the windows of ``holding`` (``count_windows``), a table.
    """
    common = frequencies(counted)
    of = ["gram", "salt"]  # one shuffle each: copies that several tasks met go where the join needs their windows
    asked = materialize(asked_windows(asking, common, width, least_words, share, more).repartition(*of).dropDuplicates([*of, "a"]), "asked")
    held = held_windows(holding, window_bitmap(asked), common, width, least_words).repartition(*of).dropDuplicates([*of, "b"])
    met = held.join(asked.hint("merge"), of).where("n_b >= need and a <> b")
    return materialize(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("shared").alias("shared")).where("n >= shared").select("a", "b"), "candidates")
