"""Problem 6: splits that keep pages of one document, author or work together.

Documents and their authors and works form a graph without any pair of documents in it (each author is a node).
Its components are found by pointer jumping and kept in a persisted table (node, root, split, n_ids) of all nodes,
authors and works included. A later batch only contracts its own edges over that table: components that were there
keep their split, new ones fill what the splits lack, and a merge of components of different splits is not made: what
is new in it is quarantined under a root of its own and gets no split, nor does what later joins it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.session import latest_version, materialize, next_version

#: Roots of quarantined nodes begin so; no node does.
QUARANTINE = "q:"
#: Author fields that name nobody, by their letters and digits only; a field without any is one, too.
PLACEHOLDERS = (
    "unknown anonymous anon na none null nil nan various notavailable notapplicable notknown unknownauthor authorunknown"
    " anonymousauthor noauthor nn tba tbd unnamed unbekannt anonym inconnu anonyme desconocido anonimo anónimo"
).split()
SHARES = {"train": 0.84, "val": 0.08, "test": 0.08}


def letters_and_digits(c: Column) -> Column:
    """Lower-case letters and digits in their order; null where there are none."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(kept != "", kept)


def _trimmed(c: Column) -> Column:
    kept = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(kept != "", kept)


def page_nodes(pages: DataFrame, id_col: str = "id", doc_col: str = "doc_id") -> DataFrame:
    """id, doc (doc_id as written, null if blank), node: the document a page is of.

    Where doc_id is blank, an id ``<doc_id>-p<digits>`` names it; where that fails, too, the page is alone.
    """
    doc, page = F.col(f"`{doc_col}`"), F.col(f"`{id_col}`").cast("string")
    named = letters_and_digits(F.regexp_extract(page, r"^(.+)-p[0-9]+$", 1))
    node = F.coalesce(F.concat(F.lit("d:"), F.coalesce(letters_and_digits(doc), named)), F.concat(F.lit("p:"), page))
    return pages.select(page.alias("id"), F.when(_trimmed(doc).isNotNull(), doc).alias("doc"), node.alias("node")).where("id is not null")


def origin_edges(origins: DataFrame, doc_col: str = "doc_id", author_col: str = "author", work_col: str = "work_id") -> DataFrame:
    """(a, b): documents and their authors and works; placeholders, blanks and nulls link nothing."""
    node = F.concat(F.lit("d:"), letters_and_digits(F.col(f"`{doc_col}`")))
    author = F.lower(_trimmed(F.col(f"`{author_col}`")))
    bare = letters_and_digits(author)
    known = F.when(bare.isNotNull() & ~bare.isin(PLACEHOLDERS), F.concat(F.lit("a:"), author))
    work = F.concat(F.lit("w:"), _trimmed(F.col(f"`{work_col}`")))
    both = origins.select(node.alias("a"), F.explode(F.array(known, work)).alias("b"))
    return both.where("a is not null and b is not null").distinct()


def twice_named(nodes: DataFrame) -> DataFrame:
    """Edges that join the documents of one page id that came under several."""
    several = nodes.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("id")
    return nodes.join(several, "id", "left_semi").select(F.col("node").alias("a"), F.concat(F.lit("p:"), "id").alias("b")).distinct()


def update_components(edges: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """(node, root, split, n_before, state) after ``edges`` came to the persisted (node, root, split, n_ids).

    States: ``kept`` (a persisted node, its split stands), ``contested`` (the same, but an edge now leads to a component
    of another split), ``quarantined`` (new or quarantined before, in a component that would join different splits
    or holds quarantined nodes: a root of its own, no split) and ``new`` (no split yet, or that of the persisted
    component it joins). Persisted components of one split that are joined become one.
    """
    if persisted is None:
        return connected_components(edges, "split-groups").select("node", "root", F.lit(None).cast("string").alias("split"), F.lit(0).cast("bigint").alias("n_before"), F.lit("new").alias("state"))
    known = persisted.select("node", "root", "split", "n_ids")
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    merged = connected_components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "split-merges")
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("merged"))
    old = known.join(merged, "root", "left").select("node", "root", "split", F.col("n_ids").alias("n_before"), F.coalesce("merged", "root").alias("merged"), F.lit(True).alias("old"))
    fresh = merged.join(known.select("root").distinct(), "root", "left_anti")
    fresh = fresh.select(F.col("root").alias("node"), "root", F.lit(None).cast("string").alias("split"), F.lit(0).cast("bigint").alias("n_before"), "merged", F.lit(False).alias("old"))
    of_merged = old.groupBy("merged").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.max(F.col("root").startswith(QUARANTINE)).alias("held"))
    placed = old.unionByName(fresh).join(of_merged, "merged", "left")
    conflict = F.coalesce((F.col("low") != F.col("high")) | F.col("held"), F.lit(False))
    stays = F.col("old") & F.col("split").isNotNull()
    apart = F.when(F.col("merged").startswith(QUARANTINE), F.col("merged")).otherwise(F.concat(F.lit(QUARANTINE), "merged"))
    return materialize(
        placed.select(
            "node",
            F.when(conflict & stays, F.col("root")).when(conflict, apart).otherwise(F.col("merged")).alias("root"),
            F.when(conflict, F.col("split")).otherwise(F.col("low")).alias("split"),
            "n_before",
            F.when(conflict & stays, "contested").when(conflict, "quarantined").when(stays, "kept").otherwise("new").alias("state"),
        ),
        "split-components",
    )


def page_groups(pages: DataFrame, origins: DataFrame, persisted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ids: id, node, low, high, blank), (nodes: node, root, split, n_before, state, n_ids, first_id, ...) of pages and persisted components.

    One row for each id however often it was delivered; ids that are null are left out. ``low`` and ``high`` are the
    least and greatest doc_id as written, ``blank`` whether one is missing. Nodes without pages (authors, works,
    documents of earlier batches) have null there. Empty tables give empty results.
    """
    nodes = materialize(page_nodes(pages), "page-nodes")
    edges = origin_edges(origins).union(twice_named(nodes))
    ids = nodes.groupBy("id").agg(F.min("node").alias("node"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.max(F.col("doc").isNull()).alias("blank"))
    per_node = ids.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n_ids"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("blank").alias("blank"))
    placed = per_node.join(update_components(edges, persisted), "node", "full")
    return ids, placed.withColumns({"root": F.coalesce("root", "node"), "state": F.coalesce("state", F.lit("new")), "n_before": F.coalesce("n_before", F.lit(0).cast("bigint"))})


def found_groups(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group_id): pages of groups of several ids that do not all carry one and the same doc_id as written."""
    nodes = nodes.where("first_id is not null")
    groups = nodes.groupBy("root").agg(F.min("first_id").alias("group_id"), F.sum("n_ids").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("blank").alias("blank"))
    groups = groups.where("n >= 2 and (blank or low <> high)").select("root", "group_id")
    return ids.select("id", "node").join(nodes.select("node", "root").join(groups, "root").select("node", "group_id"), "node").select("id", "group_id")


def assign_splits(nodes: DataFrame, shares: dict[str, float] | None = None, large: int = 2000) -> DataFrame:
    """(root, n_ids, split) of all components with pages, now or in earlier batches; quarantined ones have no split.

    New components fill what the splits lack. Those of more than 1/``large`` of all pages (at most ``large`` of them,
    so they may come to the driver) are placed one by one, the greatest first, where most is lacking; the others
    by a hash of their root, in proportion to what is lacking then. A page that an earlier batch brought counts
    again when it is delivered again.
    """
    shares = shares or SHARES
    size = F.coalesce("n_ids", F.lit(0)) + F.col("n_before")
    groups = nodes.groupBy("root").agg(F.sum(size).alias("n_ids"), F.max("split").alias("split"), F.max(F.col("state") == "quarantined").alias("held")).where("n_ids > 0")
    groups = materialize(groups, "split-sizes")
    totals = {r["s"]: r["n"] for r in groups.groupBy(F.when(F.col("held"), "-").otherwise(F.coalesce("split", F.lit("?"))).alias("s")).agg(F.sum("n_ids").alias("n")).collect()}
    total = sum(n for s, n in totals.items() if s != "-")
    lack = {s: share * total - totals.get(s, 0) for s, share in shares.items()}
    open_ = groups.where(~F.col("held") & F.col("split").isNull())
    placed: dict[str, str] = {}
    least = total / large
    for r in open_.where(F.col("n_ids") > least).orderBy(F.desc("n_ids"), "root").collect():
        best = max(lack, key=lambda s: (lack[s], s))
        placed[r["root"]] = best
        lack[best] -= r["n_ids"]
    room = {s: max(0.0, n) for s, n in lack.items()}
    whole = sum(room.values()) or 1.0
    u = F.pmod(F.xxhash64("root"), F.lit(1 << 40)) / float(1 << 40)
    names = sorted(room)
    choice, at = F.lit(names[-1]), 1.0
    for s in reversed(names[:-1]):
        at = sum(room[x] for x in names[: names.index(s) + 1]) / whole
        choice = F.when(u < at, s).otherwise(choice)
    large_map = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])[F.col("root")] if placed else F.lit(None).cast("string")
    split = F.when(~F.col("held"), F.coalesce("split", F.when(F.col("n_ids") > least, large_map), choice))
    return groups.select("root", "n_ids", split.alias("split"))


def split_pages(pages: DataFrame, origins: DataFrame, persisted: DataFrame | None = None, shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages: id, group_id, split, state), (the table to persist: node, root, split, n_ids), of one batch.

    ``persisted`` is what the batch before gave. States are those of ``update_components``; a quarantined page has no
    split. ``group_id`` is the least id of the batch in the component.
    """
    ids, nodes = page_groups(pages, origins, persisted)
    nodes = materialize(nodes, "split-nodes")
    assigned = materialize(assign_splits(nodes, shares), "split-assigned").select("root", F.col("split").alias("given"))
    first = nodes.where("first_id is not null").groupBy("root").agg(F.min("first_id").alias("group_id"))
    whole = nodes.join(assigned, "root", "left").withColumn("split", F.col("given"))
    of_node = whole.where("first_id is not null").join(first, "root").select("node", "group_id", "split", "state")
    table = whole.select("node", "root", "split", (F.coalesce("n_ids", F.lit(0)) + F.col("n_before")).alias("n_ids"))
    return ids.select("id", "node").join(of_node, "node").select("id", "group_id", "split", "state"), table


def split_batch(pages: DataFrame, origins: DataFrame, path: str, shares: dict[str, float] | None = None) -> DataFrame:
    """The pages of one batch with their splits, over the component table kept under ``path``, which it brings up to date.

    Every batch writes a whole new version of the table and leaves the earlier ones; a version counts once it is
    complete, so a run that dies changes nothing. Two batches must not run over one path at the same time.
    """
    spark = pages.sparkSession
    last = latest_version(spark, path)
    rows, table = split_pages(pages, origins, spark.read.parquet(last) if last else None, shares)
    table.write.mode("error").parquet(next_version(spark, path))
    return rows
