"""Problem 3: items of varying length into containers of fixed capacity, by vector best-fit.

A container has three capacities: characters, number of items, and attention cost (the sum of squared lengths). The
attention capacity is below what one item of full length costs, so that it bears on what is put together; an item that
costs more by itself has a container to itself and is not split.
Items go, the longest first, where they fit in all three and the weighted residual norm is least (or the weighted
dot product of demand and residual greatest). Items are spread over blocks of bounded size by a hash and packed
block by block, so nothing ever gathers in one task; only an item longer than a container is split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize, ship


#: Groups up to this number are told their numbers of blocks by a literal; beyond it by a join.
MOST_GROUPS = 10_000


def best_fit(lengths: np.ndarray, capacity: int, most_items: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.05)) -> np.ndarray:
    """The container of each length (all of 1..capacity); ties go to the container that was opened first."""
    return best_fit_report(lengths, capacity, most_items, attention, rule, weights)[0]


def best_fit_report(lengths: np.ndarray, capacity: int, most_items: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """The containers, and for each item how many open ones had room for its characters and refused it for its attention cost."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), dtype=np.int64)
    refused = np.zeros(len(lengths), dtype=np.int64)
    most = np.array([capacity, most_items, attention], dtype=np.float64)
    scale = np.array(weights) / most**2
    least = float(lengths.min()) if len(lengths) else 0.0
    room = np.empty((1024, 3))  # what the open containers have left
    names = np.empty(1024, dtype=np.int64)
    n_open = made = 0
    for i in order:
        length = float(lengths[i])
        demand = np.array([length, 1.0, length * length])
        left = room[:n_open] - demand
        enough = left >= 0
        fits = enough.all(axis=1)
        refused[i] = (enough[:, 0] & ~enough[:, 2]).sum()
        if fits.any():
            score = -(left * left) @ scale if rule == "norm" else (room[:n_open] * demand) @ scale
            at = int(np.argmax(np.where(fits, score, -np.inf)))
        else:
            if n_open == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            at = n_open
            room[at], names[at] = most, made
            room[at, 2] = max(attention, demand[2])
            n_open, made = n_open + 1, made + 1
        room[at] -= demand
        out[i] = names[at]
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least * least:  # nothing more fits; keep the order of opening
            room[at : n_open - 1], names[at : n_open - 1] = room[at + 1 : n_open].copy(), names[at + 1 : n_open].copy()
            n_open -= 1
    return out, refused


def pack(
    items: DataFrame,
    capacity: int,
    group_col: str = "item_table",
    id_col: str = "item_id",
    length_col: str = "length",
    most_items: int = 16,
    attention: float | None = None,
    rule: str = "norm",
    block_items: int = 4096,
) -> DataFrame:
    """(group, id, part, length, container, refused) of every item; containers never hold items of two groups.

    An item longer than the capacity comes as parts of full capacity and a rest, no other is split. A null or empty
    item has length 0, part 0 and no container. Equal rows are items of their own; an empty table gives an empty table;
    further columns are not read. ``attention`` is the greatest sum of squared lengths, 0.7 of that of a full item by
    default. ``refused`` counts the open containers that had room for the item's characters and not for its attention cost.
    """
    if capacity < 1 or most_items < 1 or rule not in ("norm", "dot"):
        raise ValueError("capacity and most_items must be positive, the rule norm or dot")
    attention = float(attention or 0.7 * capacity**2)
    ship(items.sparkSession)
    named = items.select(F.col(f"`{group_col}`").alias("item_table"), F.col(f"`{id_col}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{length_col}`").cast("bigint"), F.lit(0)).alias("whole"))
    parts = named.select("item_table", "item_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)).cast("int"))).alias("part", "__k"), "whole")
    parts = materialize(parts.select("item_table", "item_id", "part", F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("part") * capacity).alias("length")), "pack-items")
    sized = parts.where("length > 0")
    sizes = sized.groupBy("item_table").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_items)).cast("bigint").alias("blocks"))
    alike = sized.groupBy("item_table", "item_id", "part", "length").agg(F.count("*").alias("n"))  # equal rows are numbered, so that they spread over the blocks
    sized = alike.select("item_table", "item_id", "part", "length", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    few = sizes.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS:  # the usual case: no shuffle of the items, and no hot group in a join
        number = F.create_map(*[F.lit(x) for r in few for x in r])[F.col("item_table")] if few else F.lit(1)
        sized = sized.withColumn("blocks", number)
    else:
        sized = sized.join(sizes, "item_table")
    placed = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "part", "copy"), F.col("blocks"))).drop("blocks", "copy")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item_id", "part"], ascending=[False, True, True], kind="stable")
        bins, refused = best_fit_report(pdf["length"].to_numpy(), capacity, most_items, attention, rule)
        prefix = f"{pdf['item_table'].iloc[0]}-{pdf['block'].iloc[0]:08d}-"
        return pdf[["item_table", "item_id", "part", "length"]].assign(container=[f"{prefix}{b:05d}" for b in bins], refused=refused)

    schema = "item_table string, item_id string, part int, length bigint, container string, refused bigint"
    packed = placed.groupBy("item_table", "block").applyInPandas(run, schema)
    return packed.unionByName(parts.where("length = 0").select("item_table", "item_id", "part", "length", F.lit(None).cast("string").alias("container"), F.lit(0).cast("bigint").alias("refused")))


def fill_report(packed: DataFrame, capacity: int, most_items: int = 16) -> DataFrame:
    """Per group: parts, containers, the share of their room that is used, the fewest containers any way could need, the
    parts that some container with room refused for their attention cost, and the containers that are full by their number of items."""
    bins = packed.where("container is not null").groupBy("item_table", "container").agg(F.sum("length").alias("used"), F.count("*").alias("n"), F.count_if(F.col("refused") > 0).alias("refused"))
    report = bins.groupBy("item_table").agg(
        F.sum("n").alias("n_parts"), F.count("*").alias("n_containers"), F.max("used").alias("most_used"), F.sum("used").alias("chars"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
        F.sum("refused").alias("n_refused"), F.count_if(F.col("n") >= most_items).alias("n_full_by_items"),
    )
    return report.withColumn("least_containers", F.ceil(F.col("chars") / capacity))
