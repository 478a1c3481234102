"""Character vocabularies: inventory, coverage, extension, encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import ship


def characters(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n): every character of the corpus and how often it occurs, combined before the shuffle."""
    return texts.where(F.length(text) > 0).select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def from_lines(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """(token, id) of a vocabulary file: an empty line is the line-end token; a repeated token keeps its first place and takes no number."""
    token = F.when(F.col(line) == "", "\n").otherwise(F.col(line))
    first = lines.where(F.col(line).isNotNull()).select(token.alias("token"), order).groupBy("token").agg(F.min(order).alias("at"))
    return first.select("token", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("id"))  # a vocabulary, not a corpus


def new_characters(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Characters that the vocabulary lacks, to be appended in order."""
    return found.join(vocabulary.select(F.col("token").alias("ch")), "ch", "left_anti")


def extended(vocabulary: DataFrame, found: DataFrame) -> DataFrame:
    """The vocabulary with what it lacked at its end, most frequent first."""
    size = vocabulary.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("size"))
    place = (F.row_number().over(Window.orderBy(F.desc("n"), "ch")) - 1).cast("int")
    fresh = new_characters(found, vocabulary).select(F.col("ch").alias("token"), place.alias("k")).crossJoin(size)  # one row
    return vocabulary.select("token", "id").unionByName(fresh.select("token", (F.col("k") + F.col("size")).cast("int").alias("id")))


def coverage(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct characters and occurrences, and how many of them the vocabulary has."""
    known = found.join(vocabulary.select(F.col("token").alias("ch"), F.lit(1).alias("known")), "ch", "left")
    return known.agg(
        F.count("*").alias("n_chars"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_known"), F.sum("n").alias("n_occurrences"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_covered")
    )


def as_map(vocabulary: DataFrame, most: int = 200_000) -> dict[str, int]:
    """A bounded vocabulary as a dictionary (ValueError beyond the bound)."""
    rows = vocabulary.select("token", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the vocabulary is too large for a literal")
    return {r["token"]: r["id"] for r in rows}


def encode(text: Column, vocabulary: Column, unk: int = 2) -> Column:
    """Ids of the characters by a small map column (a lookup walks it; see ``encode_rows``); what is not in it becomes ``unk``."""
    ids = F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(vocabulary, ch), F.lit(unk)))
    return F.when(F.length(text) > 0, ids).when(text.isNotNull(), F.array().cast("array<int>"))


def encode_rows(texts: DataFrame, vocabulary: DataFrame, key: str, text: str, unk: int = 2, most: int = 200_000) -> DataFrame:
    """(key, ids); whole batches are looked up by code point, so a character costs the same in any vocabulary.

    The lookup table has a place for each code point up to the vocabulary's last, and its size is checked.
    """
    ids = {t: i for t, i in as_map(vocabulary, most).items() if len(t) == 1}
    lookup = np.full(max(map(ord, ids), default=0) + 2, unk, dtype=np.int32)  # the last place: beyond the vocabulary
    for t, i in ids.items():
        lookup[ord(t)] = i
    shared = texts.sparkSession.sparkContext.broadcast(lookup)
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            points = np.frombuffer("".join(v or "" for v in values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ends = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum([len(v or "") for v in values], out=ends[1:])
            gone = pa.array([v is None for v in values])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(table[np.minimum(points, len(table) - 1)]), mask=gone)], names=["k", "ids"])

    source = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode_rows(coded: DataFrame, vocabulary: DataFrame, key: str, ids: str, unk: str = "<|unk|>", most: int = 200_000) -> DataFrame:
    """(key, decoded) of arrays of ids."""
    tokens = {i: t for t, i in as_map(vocabulary, most).items()}
    shared = coded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            texts = [None if v is None else "".join([get(i, unk) for i in v]) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "decoded"])

    source = coded.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, decoded string").withColumnRenamed("k", key)


def decode(ids: Column, tokens: Column, unk: str = "<|unk|>") -> Column:
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(tokens, i), F.lit(unk))), "")
