"""Global order without a global task: positions in a sort of the whole table, and what follows from them.

A window without partitions would bring every row to one task, and a window by a hot key a third of them. Here the
rows are range-partitioned and sorted, every task numbers its own, and the tasks' row counts (one number for each)
give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import materialize

_IN_TASK = 33  # bits of monotonically_increasing_id that count within a task


def with_position(df: DataFrame, order: list[str | Column], out: str = "pos") -> DataFrame:
    """Adds the row's position, from 0, in the order; one shuffle. Rows that the order leaves equal may take each other's places.

    A hash of the row's place in the input is the last key, so that rows with one key, however many, are divided as well.
    """
    by = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("__tie")]
    tied = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__id", F.monotonically_increasing_id())
    numbered = materialize(ranged, "numbered")
    task = F.shiftright("__id", _IN_TASK)
    counts = numbered.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))  # a row for each task
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << _IN_TASK) - 1))
    return numbered.withColumn("__task", task).join(F.broadcast(offsets), "__task").withColumn(out, place).drop("__id", "__task", "__before")


def with_group_position(df: DataFrame, groups: list[str], order: list[str | Column], out: str = "pos") -> DataFrame:
    """Adds the position within the row's group and the group's size (``<out>_of``), however large the group."""
    placed = with_position(df, [*groups, *order], "__pos")
    named = [F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)]
    first = placed.groupBy(*named).agg(F.min("__pos").alias("__first"), F.count("*").alias(f"{out}_of"))
    same = F.col(groups[0]).eqNullSafe(F.col("__g0"))
    for k, g in enumerate(groups[1:], 1):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    own = [c for c in placed.columns if c != "__pos"]
    return placed.join(first, same).select(*own, (F.col("__pos") - F.col("__first")).alias(out), f"{out}_of")


def chunk_of(pos: Column, total: Column, parts: int) -> Column:
    """The number, from 1, of the chunk when ``total`` rows make ``parts`` chunks whose sizes differ by one at most, larger ones first."""
    small = F.floor(total / parts)
    larger = total - small * parts
    edge = larger * (small + 1)
    return (F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(larger + F.floor((pos - edge) / F.greatest(small, F.lit(1)))) + 1).cast("int")
