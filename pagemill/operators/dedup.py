"""Exact copies, splits, shards, mixing by ratio and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import hash_uniform
from pagemill.operators.positions import with_group_position, with_position
from pagemill.session import materialize


def with_digest(df: DataFrame, text: str = "text", out: str = "sha1") -> DataFrame:
    return df.withColumn(out, F.sha1(F.col(text).cast("binary")))


def first_copies(df: DataFrame, order: list[str], digest: str = "sha1", seen: DataFrame | None = None) -> DataFrame:
    """The first row of each digest in the order; digests that were ``seen`` in earlier runs are left out.

    Least-by-order is an aggregate, so a digest that a third of all rows share is combined before the shuffle and never
    sorted in one task.
    """
    others = [c for c in df.columns if c != digest]
    rank = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in others])
    if others == order and len(order) == 1:
        kept = df.groupBy(digest).agg(F.min(order[0]).alias(order[0])).select(*df.columns)
    else:
        kept = df.groupBy(digest).agg(F.min_by(row, rank).alias("__row")).select(digest, "__row.*").select(*df.columns)
    return kept if seen is None else kept.join(seen.select(digest), digest, "left_anti")


def copy_counts(df: DataFrame, digest: str = "sha1") -> DataFrame:
    each = df.groupBy(digest).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("total"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("skipped"))


def split_of(key: Column, val: float = 0.001, test: float = 0.0005, seed: int = 42) -> Column:
    """train, val or test by a hash of the key: the same wherever and in whatever order it is computed."""
    u = hash_uniform(key, seed)
    whole = 1 << 60
    return F.when(u < int(test * whole), "test").when(u < int((test + val) * whole), "val").otherwise("train")


def shard_of(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards))


def _next_starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """For a shard that starts at each line, the line that starts the next one (the number of lines, if none does)."""
    ends = np.cumsum(sizes)
    base = ends - sizes
    over = np.searchsorted(ends, base + most, side="right")  # the first line that does not fit
    held = np.where(over > 0, ends[np.maximum(over, 1) - 1], 0) - base
    alone = (over <= np.arange(len(sizes))) | (held <= 0)  # it is the shard's first line, or only empty ones come before it
    return np.minimum(over + alone, len(sizes))


def _first_start(ends: np.ndarray, most: int, used: int) -> int:
    """The line of a lane that starts a shard when the open one holds ``used`` bytes; -1 if that is none and the lane's first line starts it."""
    return -1 if used == 0 else int(np.searchsorted(ends, most - used, side="right"))


def rolled_shards(df: DataFrame, line: str, order: str, most_bytes: int, group: str = "split", lane_rows: int = 1 << 20) -> DataFrame:
    """(group, k, bytes, shard) of each line in the group's order: a new shard starts when the next line would exceed ``most_bytes`` (a longer line stands alone).

    Rolling is a running fold. It goes along lanes of ``lane_rows`` lines: how a lane goes on depends only on which of
    its lines is the first to start a shard, so a lane tells for each line what follows (stretches of lines with
    the same outcome are one row); these few rows are chained in the lanes' order; and every lane is rolled from
    its true beginning. The shards are those of one fold over the whole group. Only sizes and keys go to Python.
    """
    sized = df.select(F.col(group).alias("g"), F.col(order).alias("k"), F.coalesce(F.octet_length(line), F.lit(0)).alias("bytes"))
    placed = with_group_position(sized.withColumn("g", F.struct("g")), ["g"], ["k"])  # a null group is a group
    placed = materialize(placed.select("g", "k", "bytes", "pos", F.floor(F.col("pos") / lane_rows).cast("int").alias("lane")), "lanes")
    kinds = dict(sized.dtypes)

    def outcomes(table: pa.Table) -> pa.Table:
        sizes = table.sort_by("pos").column("bytes").to_numpy().astype(np.int64)
        n, ends = len(sizes), np.cumsum(sizes)
        following = _next_starts(sizes, most_bytes).tolist()
        more, held = [0] * (n + 1), [0] * (n + 1)  # shards that start later in the lane, and what the last one holds
        for i in range(n - 1, -1, -1):
            j = following[i]
            more[i], held[i] = (more[j] + 1, held[j]) if j < n else (0, int(ends[-1] - ends[i] + sizes[i]))
        last = min(n, int(np.searchsorted(ends, most_bytes, side="right")) + 1)  # no later line can be the first
        runs = [i for i in range(last) if i + 1 == last or (more[i], held[i]) != (more[i + 1], held[i + 1])]
        rows = [(-1, 0, more[0], held[0])] + [(k, int(ends[i]), more[i], held[i]) for k, i in enumerate(runs)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.table([pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in ("g", "lane")] + columns + [pa.array([int(ends[-1])] * len(rows), pa.int64())], names=["g", "lane", "run", "upto", "more", "held", "whole"])

    def chained(table: pa.Table) -> pa.Table:
        lanes: dict[int, list[dict]] = {}
        for r in table.select(["lane", "run", "upto", "more", "held", "whole"]).sort_by([("lane", "ascending"), ("run", "ascending")]).to_pylist():
            lanes.setdefault(r["lane"], []).append(r)
        out, used, shard = [], 0, 0
        for lane, rows in lanes.items():
            out.append((lane, used, shard))
            hit = rows[0] if used == 0 else next((r for r in rows[1:] if used + r["upto"] > most_bytes), None)
            if hit is None:
                used += rows[0]["whole"]
            else:
                shard += hit["more"] + (used > 0)
                used = hit["held"]
        lane, held, before = zip(*out)
        return pa.table([pa.array([table.column("g")[0].as_py()] * len(out), table.schema.field("g").type), pa.array(lane, pa.int32()), pa.array(held, pa.int64()), pa.array(before, pa.int64())], names=["g", "lane", "used", "before"])

    def roll(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        sizes = table.column("bytes").to_numpy().astype(np.int64)
        following, used = _next_starts(sizes, most_bytes), table.column("used")[0].as_py()
        starts = np.zeros(len(sizes), dtype=np.int64)
        at = _first_start(np.cumsum(sizes), most_bytes, used)
        if at < 0:
            at = int(following[0])
        while at < len(sizes):
            starts[at] = 1
            at = int(following[at])
        shard = (np.cumsum(starts) + table.column("before")[0].as_py()).astype(np.int32)
        return pa.table([table.column("g"), table.column("k"), table.column("bytes"), pa.array(shard)], names=["g", "k", "bytes", "shard"])

    g = f"g struct<g:{kinds['g']}>"
    ways = placed.groupBy("g", "lane").applyInArrow(outcomes, f"{g}, lane int, run bigint, upto bigint, more bigint, held bigint, whole bigint")
    entry = ways.groupBy("g").applyInArrow(chained, f"{g}, lane int, used bigint, before bigint")
    rolled = placed.join(entry, ["g", "lane"]).groupBy("g", "lane").applyInArrow(roll, f"{g}, k {kinds['k']}, bytes int, shard int")
    return rolled.select(F.col("g.g").alias(group), "k", "bytes", "shard")


def interleave(main: DataFrame, other: DataFrame, ratio: float, key: str, seed: int = 7) -> DataFrame:
    """Both sources with ``origin`` and ``place``; in the order of place and key, about ``ratio`` of any stretch is of the other one. All rows come out.

    Each source's rows are spread by a hash over its own length, the other's over main's length * ratio / (1 - ratio);
    what is longer runs on alone, as when one of two streams ends.
    """
    spread = lambda df, name, scale: df.select("*", F.lit(name).alias("origin"), (hash_uniform(F.col(key).cast("string"), f"{name}{seed}") / float(1 << 60) * scale).alias("place"))
    n_other, n_main = other.count(), main.count()
    needed = n_main * ratio / (1 - ratio) if ratio < 1 else float("inf")
    scale = max(1.0, n_other / needed) if needed and needed != float("inf") else 1.0
    return spread(main, "main", 1.0).unionByName(spread(other, "other", scale), allowMissingColumns=True)


def replaced(key: Column, ratio: float, seed: int = 7) -> Column:
    """Whether a row gives way to one of the other source."""
    return hash_uniform(key, seed) < int(ratio * (1 << 60))


def shuffled(df: DataFrame, key: str, epoch: int, seed: int = 42) -> DataFrame:
    """``df`` with ``pos``, its place from 0 in a global order that changes with the epoch and only with it (SHA-256 of key, epoch and seed)."""
    placed = df.withColumn("__place", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{epoch}:{seed}")), 256))
    return with_position(placed, ["__place", key]).drop("__place")


def bucket_batches(df: DataFrame, batch_size: int, key: str, buckets: tuple[str, str] = ("grid_h", "grid_w"), drop_last: bool = False, seed: int = 42) -> DataFrame:
    """Batches of equal grids: rows of a bucket in hash order, cut into batches; rows without a grid are left out.

    Positions come from one sort of the whole table, so a bucket of a third of all rows is no task of its own.
    """
    grid = list(buckets)
    rows = df.where(F.col(grid[0]).isNotNull() & F.col(grid[1]).isNotNull()).withColumn("__h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256))
    placed = with_group_position(rows, grid, ["__h", key])
    batch = F.floor(F.col("pos") / batch_size)
    if drop_last:
        placed = placed.where((batch + 1) * batch_size <= F.col("pos_of"))
    return placed.withColumn("batch", batch.cast("int")).drop("__h", "pos", "pos_of")
