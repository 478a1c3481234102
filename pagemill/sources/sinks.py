"""Sinks: split and shard folders of JSON lines, vocabularies, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_shards(pages: DataFrame, path: str, split: str = "split", most_rows: int = 500_000) -> None:
    """JSON lines in a folder for each split, rolled by rows within a task. Compact or full records alike."""
    pages.write.mode("overwrite").partitionBy(split).option("maxRecordsPerFile", most_rows).option("ignoreNullFields", "false").json(path)


def write_rolled(lines: DataFrame, path: str, line: str = "line") -> None:
    """Lines with split, shard and their order k (of ``rolled_shards``) as one folder for each shard, their order kept."""
    keys = ["split", "shard"]
    lines.repartition(*keys).sortWithinPartitions(*keys, "k").select(*keys, F.col(line).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_rejects(rows: DataFrame, path: str, reason: str = "reject_reason") -> None:
    rows.where(F.col(reason).isNotNull()).write.mode("overwrite").partitionBy(reason).json(path)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON line for each row; non-ASCII characters stay."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One token a line in order of the ids; the line-end token is an empty line. A vocabulary is small, so one file."""
    value = F.when(F.col("token") == "\n", "").otherwise(F.col("token"))
    vocabulary.orderBy("id").select(value.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def image_chat(pages: DataFrame, prompt: str = "Read the text in the image.", folder: str = "images") -> DataFrame:
    """Pages as chat rows with the path of the image that a renderer writes."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    name = F.concat(F.lit(f"{folder}/"), F.regexp_replace("id", r"[^\p{L}\p{N}\-_.]", "_"), F.lit(".png"))
    return pages.select(F.array(turn("user", F.lit("<image>\n" + prompt)), turn("assistant", F.col("target_text"))).alias("messages"), F.array(name).alias("images"))


def preview(df: DataFrame, key: str, n: int, share: float = 1.0, seed: int = 42) -> DataFrame:
    """A reproducible sample of at most ``n`` rows."""
    chosen = df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))
    return chosen.orderBy(F.xxhash64(F.lit(seed + 1), key), key).limit(n)


def keep_last(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of an order, as a retention of checkpoints does."""
    return df.orderBy(F.desc(order)).limit(n)
