"""Images of chat rows: files as binary rows, joined by path; decoding is left to a codec that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, content, length) of the images in a folder at any depth; Spark's task retries replace own ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


def with_first_image(rows: DataFrame, images: DataFrame, root: str, images_col: str = "images") -> DataFrame:
    """Rows with the content of their first image; rows without images, or whose first is missing, are left out."""
    named = rows.withColumn("__path", F.concat(F.lit(root.rstrip("/") + "/"), F.get(images_col, 0)))
    found = images.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), "content")
    return named.join(found, "__path").drop("__path")


def decoded_images(rows: DataFrame, codec: Callable[[bytes], np.ndarray], key: str, content: str = "content") -> DataFrame:
    """(key, height, width, pixels as bytes) by a codec (bytes -> [H, W, C] uint8); what it cannot read is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf["key"], pdf["content"]):
                try:
                    image = codec(bytes(data))
                except Exception:  # a broken image is no reason to lose the batch
                    continue
                out.append((k, image.shape[0], image.shape[1], image.tobytes()))
            yield pd.DataFrame(out, columns=["key", "height", "width", "pixels"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, height int, width int, pixels binary")
