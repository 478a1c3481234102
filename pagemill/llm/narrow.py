"""A large table narrowed to the rows whose keys may be in another one, without shuffling the large one.

The keys' hashes set bits in a bitmap of bounded size, which is broadcast in parts of 4 KB; only rows that meet a set
bit go on to the exact join. A row that should stay always stays; how many others do depends on the bits for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26  # 8 MB, the most that is ever broadcast


def narrowed(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ``keys``; null never is. ``keys`` is counted, so it should be a table."""
    n = keys.count()
    bits = min(MOST_BITS, max(18, (32 * max(n, 1) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(1 << bits)) + 1
    marked = keys.where(F.col(f"`{key}`").isNotNull()).select(place(key).alias("__h"))
    parts = marked.groupBy(F.expr("bitmap_bucket_number(__h)").alias("__part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__h))").alias("__bits"))
    hashed = df.where(F.col(f"`{column}`").isNotNull()).withColumn("__h", place(column)).withColumn("__part", F.expr("bitmap_bucket_number(__h)"))
    met = hashed.join(F.broadcast(parts), "__part")  # at most 2**(MOST_BITS - 15) rows of 4 KB
    byte = "conv(hex(substring(__bits, cast(bitmap_bit_position(__h) div 8 + 1 as int), 1)), 16, 10)"
    return met.where(F.expr(f"(shiftright(cast({byte} as int), cast(bitmap_bit_position(__h) % 8 as int)) & 1) = 1")).drop("__h", "__part", "__bits")
