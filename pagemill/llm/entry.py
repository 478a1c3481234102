"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import mixing, neardup, overlap, packing, pairs, pieces, quality, splits, subjects, tokenizer
from pagemill.session import materialize, spread, table, work_path


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _, found = overlap.split_overlaps(spread(table(spark, sf_dir, "page_records")))
    found = overlap.page_pairs(members, found)
    return found.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: pages with overlaps, pairs, the mean overlap fraction and the doc_ids concerned."""
    pages = spread(table(spark, sf_dir, "page_records"))
    members, fractions, found = overlap.split_overlaps(pages)
    return overlap.report(pages, members, fractions, found)


def p1_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, fractions, _ = overlap.split_overlaps(spread(table(spark, sf_dir, "page_records")))
    return members.where("not train").join(fractions.withColumnRenamed("overlap", "overlap_fraction"), "key").select("id", "split", "overlap_fraction")


def p2_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_records"))
    return subjects.page_areas(pages, subjects.fit_lexicon(pages, table(spark, sf_dir, "area_examples")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_areas(spark, sf_dir).select("id", "area")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_areas(spark, sf_dir).groupBy("area").agg(F.count("*").alias("n_pages"), F.sum("share").alias("n_page_shares"))


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).first()
    return row["max_chars"], row["overlap_chars"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target_texts of the tasks and of the pages (a page delivered again is one)."""
    tasks = table(spark, sf_dir, "task_specs").select(F.lit("task_specs").alias("item_table"), F.col("spec_id").cast("string").alias("item_id"), F.length("target_text").alias("length"))
    pages = spread(table(spark, sf_dir, "page_records")).groupBy("id").agg(F.max(F.length("target_text")).alias("length"))
    return tasks.union(pages.select(F.lit("page_records"), "id", "length"))


def p3_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_items(spark, sf_dir), _limit(spark, sf_dir, "container")[0])


def p3_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = _limit(spark, sf_dir, "container")[0]
    return packing.fill_report(packing.pack(_items(spark, sf_dir), capacity), capacity)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = neardup.near_duplicates(spread(table(spark, sf_dir, "page_records")))
    return pairs.pairs_within(members.select("id", "root"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_records"))
    members, links = neardup.near_duplicates(pages)
    return neardup.group_report(members, links, neardup.link_counts(members, pages))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.page_pieces(spread(table(spark, sf_dir, "page_records")), *_limit(spark, sf_dir, "piece"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.oversized_pieces(pieces.page_texts(spread(table(spark, sf_dir, "page_records"))), *_limit(spark, sf_dir, "piece"))
    return cut.where("n_pieces > 1").select("id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.found_groups(*splits.page_groups(spread(table(spark, sf_dir, "page_records")), table(spark, sf_dir, "doc_origins")))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages at once, from an empty table of components."""
    pages, _ = splits.split_pages(spread(table(spark, sf_dir, "page_records")), table(spark, sf_dir, "doc_origins"))
    return pages


def p6_incremental(spark: SparkSession, sf_dir: str, before: str = "2025-07-01") -> DataFrame:
    """What was there before a day is split first; the rest comes as a second batch over the persisted components.

    A page that was delivered in both is in its last batch. Rows without a time belong to the second.
    """
    pages, origins = spread(table(spark, sf_dir, "page_records")), table(spark, sf_dir, "doc_origins")
    path = work_path(spark, "p6-components")
    early = lambda c: F.coalesce(F.col(c) < before, F.lit(False))
    first = materialize(splits.split_batch(pages.where(early("ingested_at")), origins.where(early("registered_at")), path), "first-batch")
    second = materialize(splits.split_batch(pages.where(~early("ingested_at")), origins.where(~early("registered_at")), path), "second-batch")
    return second.withColumn("batch", F.lit(2)).unionByName(first.join(second, "id", "left_anti").withColumn("batch", F.lit(1)))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(spread(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_running_text(quality.text_statistics(spread(table(spark, sf_dir, "documents"))))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_column(spread(table(spark, sf_dir, "documents")), "text", ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_fractions": p1_fractions,
    "p2_found": p2_found,
    "p2_areas": p2_areas,
    "p2_counts": p2_counts,
    "p3_containers": p3_containers,
    "p3_fill": p3_fill,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_incremental": p6_incremental,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
}

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sql_trim(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g'), '')"


def _sql_key(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


_SQL_TARGET = """CASE WHEN len(coalesce(b.parts, [])) > 0 THEN array_to_string(list_transform(b.parts, lambda p: coalesce(CASE WHEN p.kind = 'text' THEN p.text ELSE p.target END, p.text, p.target, '')), '') ELSE b.target END"""

#: The exact results where SQL can say them; the other problems are tested against plain versions in tests/llm.
SQL: dict[str, str] = {
    "p5_found": f"""SELECT DISTINCT id FROM page_records WHERE id IS NOT NULL AND length(CASE WHEN target_text <> '' THEN target_text
        ELSE coalesce(array_to_string(list_filter(list_transform(blocks, lambda b: {_SQL_TARGET}), lambda t: t <> ''), chr(10)), '') END) > (SELECT max_chars FROM size_limits WHERE limit_name = 'piece')""",
    "p6_found": f"""WITH RECURSIVE pages AS (SELECT DISTINCT id, CASE WHEN {_sql_trim('doc_id')} IS NOT NULL THEN doc_id END AS doc,
            coalesce('d:' || coalesce({_sql_key('doc_id')}, {_sql_key("regexp_extract(id, '^(.+)-p[0-9]+$', 1)")}), 'p:' || id) AS node FROM page_records WHERE id IS NOT NULL),
        origins AS (SELECT 'd:' || {_sql_key('doc_id')} AS node, lower({_sql_trim('author')}) AS author, {_sql_trim('work_id')} AS work FROM doc_origins),
        known AS (SELECT node, 'a:' || author AS other FROM origins WHERE {_sql_key('author')} NOT IN ({', '.join(repr(p) for p in splits.PLACEHOLDERS)})
            UNION SELECT node, 'w:' || work FROM origins UNION SELECT node, 'p:' || id FROM pages),
        links AS (SELECT node AS a, other AS b FROM known WHERE node IS NOT NULL AND other IS NOT NULL UNION SELECT other, node FROM known WHERE node IS NOT NULL AND other IS NOT NULL),
        docs AS (SELECT DISTINCT x.a AS a, y.b AS b FROM links x JOIN links y ON x.b = y.a WHERE x.a LIKE 'd:%' AND y.b LIKE 'd:%' AND x.a <> y.b),
        reach AS (SELECT node AS a, node AS b FROM pages UNION SELECT r.a, d.b FROM reach r JOIN docs d ON d.a = r.b),
        roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
        stats AS (SELECT root, min(id) AS group_id, count(DISTINCT id) AS n, count(DISTINCT doc) AS n_docs, count(*) FILTER (doc IS NULL) AS blanks FROM pages JOIN roots USING (node) GROUP BY root)
        SELECT DISTINCT id, group_id FROM pages JOIN roots USING (node) JOIN stats USING (root) WHERE n > 1 AND (n_docs > 1 OR blanks > 0)""",
}
