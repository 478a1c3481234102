"""Connected components by contraction: hook every node to its least neighbour, jump pointers to the roots,
relabel the edges by the roots and go on with what is left. Each round at least halves the nodes that still
have edges, so the rounds grow with the logarithm of the longest chain; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize


def _jump(pointers: DataFrame, name: str) -> DataFrame:
    """Pointer jumping: follows ``to`` until every node points to a root (a root is no node of the table)."""
    while True:
        hop = pointers.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        joined = pointers.join(hop, F.col("to") == F.col("__n"), "left")
        pointers = materialize(joined.select("node", F.coalesce("__t", "to").alias("to"), F.col("__t").isNotNull().alias("moved")), name)
        if not pointers.where("moved").limit(1).count():
            return pointers.select("node", "to")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node of the component.

    Loops and null ends link nothing, though a node with only a loop comes out as its own root; repeated edges
    count once; no edges give an empty table.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    rest = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while rest.limit(1).count():
        # the pointers are a forest: they always lead to a smaller node
        both = rest.select("a", "b").union(rest.select(F.col("b"), F.col("a")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).where("to < node")
        roots = _jump(hooks, f"{name}-jump")
        maps.append(roots)
        for end in ("a", "b"):
            rest = rest.join(roots.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end, "left")
        rest = rest.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = nodes.select("node", F.col("node").alias("root"))
    for m in maps:
        labels = labels.join(m.select(F.col("node").alias("root"), F.col("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(labels, f"{name}-labels")
