"""The engine's queries over the test tables, one for each operator, and the same in SQL (see ``oracle``)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import layout as L
from pagemill.functions import text as X
from pagemill.functions import udfs
from pagemill.operators import blocks as B
from pagemill.operators import dedup as D
from pagemill.operators import paging as P
from pagemill.operators import positions as N
from pagemill.operators import qc as Q
from pagemill.operators import render as G
from pagemill.operators import schedule as C
from pagemill.operators import sequences as S
from pagemill.operators import vocab as V
from pagemill.plans.oracle import SQL  # noqa: F401  (the driver asks for both here)
from pagemill.session import once, ship, spread, table, work_path
from pagemill.sources import records as R
from pagemill.sources import sinks as K
from pagemill.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "page_records"))


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    """Documents with normalised text (without NFC, as plain SQL can repeat it) and its digest."""
    rows = docs(spark, d).select("doc_id", "added_at", "text")
    return D.with_digest(once(rows, "text", X.normalize(F.col("text"), composed=False)).where("text <> ''"))


# -- sources and fields ------------------------------------------------------------------------------------------


@query
def raw_scan_skip(spark, d):
    return R.parsed(table(spark, d, "raw_records"), policy="skip").groupBy("source_file").agg(F.count("*").alias("n"))


@query
def raw_scan_rejects(spark, d):
    rows = R.parsed(table(spark, d, "raw_records"), policy="count")
    return rows.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query
def raw_scan_fail_file(spark, d):
    return R.parsed(table(spark, d, "raw_records"), policy="fail_file").groupBy("source_file").agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"))


@query
def raw_scan_objects(spark, d):
    """Values that are no objects come as the text of one, whichever type they have."""
    rows = R.parsed(table(spark, d, "raw_records").unionByName(spark.createDataFrame([("made", 1, '"only words"'), ("made", 2, "17"), ("made", 3, '["a", "b"]'), ("made", 4, '{"text": "x"}'), ("made", 5, "{bad")], "source_file string, line_no bigint, line string")))
    return rows.select("source_file", "line_no", F.try_variant_get(R.as_object(F.col("record")), "$.text", "string").alias("text"))


@query
def compact_rejects(spark, d):
    """Lines of compact pages among raw ones: malformed lines and those without a text are counted."""
    lines = K.as_json(pages(spark, d).select(F.col("id").alias("i"), F.col("target_text").alias("t")), "i", "t").select(F.lit("pages").alias("source_file"), F.lit(0).cast("bigint").alias("line_no"), "line")
    rows = R.parsed(lines.unionByName(table(spark, d, "raw_records")), policy="count", required="t")
    return rows.groupBy("source_file", F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query
def file_lines(spark, d):
    """Raw lines written as compressed and as plain text, found by patterns and read back."""
    base = work_path(spark, "lines")
    lines = table(spark, d, "raw_records").where("line not like '%\r%'").select("line")
    lines.write.option("compression", "gzip").text(f"{base}/a")
    lines.write.text(f"{base}/b")
    found = R.resolved(spark, [f"{base}/*", f"{base}/a"])
    return R.read_lines(spark, found).groupBy(F.element_at(F.split("source_file", "/"), -2).alias("folder"), F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def row_estimate(spark, d):
    """Rows of a text file by the density of its line ends; exact within the sample."""
    path = work_path(spark, "estimate")
    table(spark, d, "raw_records").where("line not like '%\r%'").select("line").coalesce(1).write.text(path)
    return spark.createDataFrame([(R.estimated_rows(spark, path),)], "n bigint")


@query
def whole_json(spark, d):
    """Files that are one JSON value each: the records in their container."""
    path = work_path(spark, "whole")
    good = R.parsed(table(spark, d, "raw_records")).groupBy(F.md5("source_file").alias("file")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    good.select("file", F.concat(F.lit('{"note": 1, "records": ['), F.array_join("x.line", ", "), F.lit("]}")).alias("value")).write.partitionBy("file").text(path)
    rows = R.exploded(spark, path)
    return rows.select(F.regexp_extract("source_file", "file=([0-9a-f]+)", 1).alias("file"), "record_index", F.try_variant_get("record", "$.text", "string").alias("text"))


@query
def pick_fields(spark, d):
    return R.picked(R.parsed(table(spark, d, "raw_records"))).select("source_file", "line_no", "text", "subject", "doc_id")


@query
def fallback_doc_id(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.fallback_id(F.col("text")).alias("sha12"))


@query
def random_access(spark, d):
    return R.row_at(docs(spark, d).select("doc_id", "source"), "doc_id", -3)


@query
def global_index(spark, d):
    """Two corpora with consecutive positions in each."""
    both = docs(spark, d).select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("key")).union(pages(spark, d).select(F.lit("page_records"), "id").distinct())
    return N.with_group_position(both, ["corpus"], ["key"]).select("corpus", "key", F.col("pos").cast("int").alias("pos"))


@query
def nested_fields(spark, d):
    """The first filled one of a dotted path and plain fields, whatever its type."""
    rows = R.parsed(table(spark, d, "raw_records"))
    return rows.select("source_file", "line_no", R.nested_field(F.col("record"), "document.text", "text", "content").alias("value"))


@query
def manifest_scan(spark, d):
    """One of four shards of an epoch's seeded order, at most fifty samples, as a worker of a training run reads it."""
    rows = docs(spark, d).where(F.length("text") > 0).select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":1:42")), 256).alias("place"))
    return rows.where(D.shard_of(X.hash_uniform(F.col("doc_id").cast("string"), "shard"), 4) == 1).orderBy("place").limit(50)


# -- text --------------------------------------------------------------------------------------------------------


@query
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", X.normalize(F.col("text")).alias("text_norm"))


@query
def whitespace_normalize(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_spaces(F.col("text")).alias("text_norm"))


@query
def unicode_nfc(spark, d):
    return docs(spark, d).select("doc_id", X.compose(F.col("text")).alias("nfc_text"))


@query
def unicode_issues(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.has_unicode_issues(F.col("text")).alias("has_issues"), X.has_cjk(F.col("text")).alias("has_cjk"))


@query
def html_flags(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.has_tags(F.col("text")).alias("has_html"), X.has_risky_tags(F.col("text")).alias("risky"))


@query
def strip_html(spark, d):
    return docs(spark, d).select("doc_id", X.strip_tags(F.col("text"), unescape=False).alias("visible"))


@query
def strip_html_unescaped(spark, d):
    return docs(spark, d).select("doc_id", X.strip_tags(F.col("text")).alias("visible"))


@query
def escape_html(spark, d):
    return docs(spark, d).select("doc_id", X.escape_html(F.col("text")).alias("escaped"))


@query
def text_flags(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.text_flags(F.col("text")).alias("flags"))


@query
def flag_distribution(spark, d):
    flags = docs(spark, d).where("text is not null").select(X.text_flags(F.col("text")).alias("flags"))
    return flags.groupBy("flags").agg(F.count("*").alias("n"))


@query
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def paragraph_split(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.paragraphs(X.unix_lines(F.col("text")))).alias("pos", "paragraph"))


@query
def paragraph_chunks(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.paragraph_chunks(X.normalize(F.col("text"), collapse=False, composed=False))).alias("pos", "chunk"))


@query
def safe_boundaries(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.safe_boundaries(F.col("text")).cast("array<bigint>").alias("positions"))


@query
def inline_math_test(spark, d):
    """Every formula of the pages' parts, as the heuristic for dollars sees it."""
    part = pages(spark, d).select("id", F.explode("blocks").alias("b")).select("id", F.explode("b.parts").alias("p")).where("p.tex is not null")
    return part.select("id", F.col("p.tex").alias("tex"), X.looks_like_math(F.col("p.tex")).alias("math"), X.is_currency(F.col("p.tex")).alias("price")).distinct()


@query
def math_subjects(spark, d):
    return pages(spark, d).groupBy(X.is_math_subject(F.col("subject")).alias("math_subject")).agg(F.count("*").alias("n"))


@query
def file_names(spark, d):
    return pages(spark, d).select(X.safe_file_name(F.col("id")).alias("name")).distinct()


# -- copies, splits, shards --------------------------------------------------------------------------------------


@query
def exact_dedup_first(spark, d):
    return D.first_copies(_tidy(spark, d).select("doc_id", "sha1"), ["doc_id"])


@query
def dedup_counts(spark, d):
    return D.copy_counts(_tidy(spark, d))


@query
def dedup_incremental(spark, d):
    """Documents of the second half of 2025 whose text was not there in the first."""
    tidy = _tidy(spark, d)
    old, new = tidy.where("added_at < '2025-07-01'"), tidy.where("added_at >= '2025-07-01'")
    return D.first_copies(new.select("doc_id", "sha1"), ["doc_id"], seen=old.select("sha1").distinct())


@query
def split_assign(spark, d):
    ids = pages(spark, d).select("id").distinct()
    return ids.select("id", D.split_of(F.col("id"), 0.08, 0.08).alias("split"))


@query
def split_counts(spark, d):
    split = D.split_of(F.col("doc_id").cast("string"), 0.08, 0.08)
    return docs(spark, d).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))


@query
def repackage_counts(spark, d):
    """Normalise, keep first copies, flag and split: what the repackaging of a corpus counts."""
    flagged = _tidy(spark, d).select("doc_id", "sha1", X.text_flags(F.col("text")).alias("flags"), F.length("text").alias("n"))  # the texts are not shuffled
    rows = D.first_copies(flagged, ["doc_id"]).withColumn("split", D.split_of(F.col("doc_id").cast("string"), 0.08, 0.08))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_pages"), F.sum("n").alias("chars"), F.count_if(F.col("flags").bitwiseAND(1) > 0).alias("math"), F.count_if(F.col("flags").bitwiseAND(2) > 0).alias("tables"), F.count_if(F.col("flags").bitwiseAND(4) > 0).alias("html")
    )


@query
def ingest_counters(spark, d):
    """What an ingest counts: records, empty ones, copies, risky markup."""
    rows = R.picked(R.parsed(table(spark, d, "raw_records")))
    rows = D.with_digest(rows.select("text", X.normalize(F.col("text"), composed=False).alias("tidy")), "tidy")
    filled = F.col("tidy") != ""
    each = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.count_if(filled).alias("filled"), F.count_if(filled & X.has_risky_tags(F.col("text"))).alias("risky"))
    return each.agg(F.sum("n").alias("documents"), (F.sum("n") - F.sum("filled")).alias("empty"), F.sum(F.greatest(F.col("filled") - 1, F.lit(0))).alias("copies"), F.sum("risky").alias("risky"))


@query
def build_counters(spark, d):
    """What the building of pages from documents counts: documents, copies, empty ones, pages by kind and split."""
    tidy = D.with_digest(docs(spark, d).select("doc_id", "subject", "text", X.normalize(F.col("text"), composed=False).alias("tidy")), "tidy")
    each = tidy.groupBy("sha1").agg(F.count("*").alias("n"), F.count_if(F.col("tidy") != "").alias("filled"))
    seen = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs_seen"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"), F.count_if(F.col("filled") > 0).alias("docs_processed"))
    kept = D.first_copies(tidy.where("tidy <> ''").select("doc_id", "sha1"), ["doc_id"]).select("doc_id")
    made = P.plain_pages(docs(spark, d).select("doc_id", "subject", "text").join(kept, "doc_id", "left_semi"))
    split = D.split_of(F.regexp_extract("i", "^(.+)-p[0-9]+$", 1), 0.08, 0.08)
    flag = lambda k: F.count_if(F.col("f").bitwiseAND(k) > 0)
    paged = made.withColumn("split", split).agg(F.count("*").alias("pages"), *[F.count_if(F.col("split") == x).alias(f"pages_{x}") for x in ("train", "val", "test")], flag(1).alias("math_pages"), flag(2).alias("table_pages"), F.count_if(F.length("t") < 20).alias("short_pages"))
    both = seen.crossJoin(F.broadcast(paged))  # one row each
    return both.select("docs_seen", (F.col("docs_seen") - F.col("filled")).alias("empty"), (F.col("filled") - F.col("docs_processed")).alias("dedup_skipped"), "docs_processed", *paged.columns)


@query
def split_folders(spark, d):
    """Full page records as JSON lines in a folder for each split, read back."""
    path = work_path(spark, "folders")
    rows = pages(spark, d).where("split is not null").select("id", "doc_id", "page_index", "subject", "blocks", "target_text", "has_math", "has_table", "flags", "split")
    K.write_shards(rows, path, most_rows=1000)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("id", "doc_id", "page_index", "subject", F.size("blocks").alias("n_blocks"), F.sha1(P.join_targets(F.col("blocks")).cast("binary")).alias("blocks_sha1"), "target_text", "has_math", "has_table", "flags", "split").distinct()


@query
def shard_round_robin(spark, d):
    """The k-th document by id goes to shard k mod 4."""
    placed = N.with_position(docs(spark, d).select("doc_id"), ["doc_id"])
    return placed.groupBy(D.shard_of(F.col("pos"), 4).cast("int").alias("shard")).agg(F.count("*").alias("n"))


@query
def contiguous_chunks(spark, d):
    """The documents in order of their ids as four chunks of nearly equal size."""
    placed = N.with_position(docs(spark, d).select("doc_id"), ["doc_id"])
    total = placed.agg(F.count("*").alias("total"))
    part = placed.crossJoin(F.broadcast(total)).select("doc_id", N.chunk_of(F.col("pos"), F.col("total"), 4).alias("chunk"))  # one row
    return part.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query
def preview_sample(spark, d):
    """A reproducible tenth of the pages, by a hash of the id."""
    return pages(spark, d).where(X.hash_uniform(F.col("id"), "preview") < int(0.1 * (1 << 60))).select("id").distinct()


@query
def shard_roll(spark, d):
    lines = docs(spark, d).where("text is not null").select(D.split_of(F.col("doc_id").cast("string"), 0.08, 0.08).alias("split"), "doc_id", "text")
    return D.rolled_shards(lines, "text", "doc_id", 65_536).select("split", F.col("k").alias("doc_id"), "bytes", "shard")


@query
def epoch_shuffle(spark, d):
    """All documents in the seeded order of one epoch."""
    return D.shuffled(docs(spark, d).select("doc_id"), "doc_id", 3)


@query
def epoch_order(spark, d):
    """The orders of two epochs: the same documents, each order its own."""
    first, second = (D.shuffled(docs(spark, d).select("doc_id"), "doc_id", e).withColumn("epoch", F.lit(e)) for e in (1, 2))
    return first.unionByName(second).select("epoch", "doc_id", "pos")


@query
def ratio_interleave(spark, d):
    """All documents and chats in one order, a fifth of which are chats as long as both last."""
    main = docs(spark, d).select(F.col("doc_id").alias("key"))
    other = table(spark, d, "chat_rows").select(F.col("chat_id").alias("key"))
    return N.with_position(D.interleave(main, other, 0.2, "key"), ["place", "key", "origin"]).select("origin", "key", "pos")


@query
def ratio_replace(spark, d):
    gone = D.replaced(F.col("doc_id").cast("string"), 0.25)
    return docs(spark, d).select("doc_id", F.when(gone, "text").otherwise("image").alias("kind"))


# -- blocks and pages --------------------------------------------------------------------------------------------


@query
def block_targets(spark, d):
    b = pages(spark, d).select("id", F.posexplode("blocks").alias("pos", "b")).where("id is not null")
    return b.select("id", "pos", F.col("b.kind").alias("kind"), P.block_target(F.col("b")).alias("target"), P.block_cost(F.col("b")).alias("cost")).distinct()


@query
def page_targets(spark, d):
    return pages(spark, d).where("blocks is not null").select("id", P.join_targets(F.col("blocks")).alias("target")).distinct()


@query
def page_flags(spark, d):
    return pages(spark, d).where("blocks is not null").select("id", P.block_flags(F.col("blocks")).alias("flags"), X.text_flags(P.join_targets(F.col("blocks"))).alias("text_flags")).distinct()


@query
def pack_pages(spark, d):
    """Plain paragraphs packed to a budget of 950: blocks and cost of each page."""
    chunks = docs(spark, d).select("doc_id", X.paragraph_chunks(X.normalize(F.col("text"), collapse=False, composed=False)).alias("chunks")).where(F.size("chunks") > 0)
    costs = chunks.select("doc_id", F.transform("chunks", lambda c: F.greatest(F.lit(1), F.length(c))).alias("costs"))
    each = costs.select("doc_id", F.explode(F.arrays_zip("costs", P.page_numbers(F.col("costs")).alias("page"))).alias("x"))
    return each.groupBy("doc_id", F.col("x.page").alias("page")).agg(F.count("*").alias("n_blocks"), F.sum("x.costs").alias("cost"))


@query
def compact_pages(spark, d):
    """The documents as plain text: compact page records."""
    rows = docs(spark, d).select("doc_id", F.coalesce("subject", F.lit("")).alias("subject"), "text")
    return P.plain_pages(rows)


@query
def full_parse_pages(spark, d):
    return P.compact(P.document_pages(docs(spark, d).select("doc_id", "subject", "text")))


@query
def html_blocks(spark, d):
    """The blocks of documents with tags, by the structured reader."""
    tagged = docs(spark, d).where(X.has_tags(F.col("text"))).select("doc_id", "subject", "text")
    found = P.document_blocks(tagged).select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    return found.select("doc_id", "pos", F.col("b.kind").alias("kind"), P.block_target(F.col("b")).alias("target"))


@query
def parse_blocks_udtf(spark, d):
    """The parser as a table function in SQL."""
    B.register(spark)
    docs(spark, d).where(F.length("text") > 0).select("doc_id", X.normalize(F.col("text"), collapse=False).alias("text")).createOrReplaceTempView("pagemill_texts")
    return spark.sql("SELECT doc_id, p.pos, p.block.kind AS kind FROM pagemill_texts, LATERAL parse_blocks(text, 420) p")


@query
def page_markup(spark, d):
    return pages(spark, d).where("blocks is not null").select("id", F.sha1(F.array_join(F.transform("blocks", P.block_html), "\n").cast("binary")).alias("digest"), F.array_join(F.transform("blocks", P.block_html), "\n").alias("html")).distinct()


@query
def page_documents(spark, d):
    """Whole HTML pages for a renderer, and their digests."""
    html = P.page_html(F.col("blocks"), 1024, 512)
    return pages(spark, d).where("blocks is not null").select("id", html.alias("html"), F.sha1(html.cast("binary")).alias("digest")).distinct()


@query
def render_plan(spark, d):
    """Canvas or reject reason of each page, by the deterministic estimator behind the renderer's interface."""
    return G.planned(pages(spark, d).select("id", "blocks").dropDuplicates(["id"]))


@query
def image_chat_rows(spark, d):
    """Pages as chat rows for image training."""
    rows = K.image_chat(pages(spark, d).where("target_text <> ''").select("id", "target_text").distinct())
    return rows.select(F.get("images", 0).alias("image"), F.get("messages", 0)["content"].alias("prompt"), F.get("messages", 1)["content"].alias("answer"))


@query
def compact_json(spark, d):
    """Pages as compact records in JSON lines, read back."""
    rows = pages(spark, d).where("target_text <> ''").select(F.col("id").alias("i"), F.col("target_text").alias("t"), F.coalesce("subject", F.lit("")).alias("s"), F.coalesce("flags", F.lit(0)).alias("f"))
    back = K.as_json(rows, "i", "t", "s", "f").select(F.from_json("line", "i string, t string, s string, f int").alias("r"))
    return back.select("r.*").distinct()


@query
def page_manifest(spark, d):
    """Pages with the digest of their target and at least 20 characters."""
    rows = pages(spark, d).where(F.length("target_text") >= 20)
    return rows.select("id", F.sha1(F.col("target_text").cast("binary")).alias("sha1")).distinct()


# -- tasks, styles, sequences ------------------------------------------------------------------------------------


@query
def task_sample_exact(spark, d):
    rows = pages(spark, d).where("target_text <> ''").select("id", "target_text").distinct()
    return rows.select("id", udfs.sample_task()(F.col("id"), F.col("target_text"), F.lit(0)).alias("t")).select("id", "t.*")


@query
def task_sample_hash(spark, d):
    """The task of each page by cumulative weights over a hash: portable, without Python."""
    u = X.hash_uniform(F.col("id"), "task:0:42")
    choice, total = None, 0.0
    marks = []
    for name, w in udfs.TASK_WEIGHTS.items():
        total += w
        marks.append((name, int(round(total, 6) * (1 << 60))))
    choice = F.lit(marks[-1][0])
    for name, mark in reversed(marks[:-1]):
        choice = F.when(u < mark, name).otherwise(choice)
    return pages(spark, d).select("id").distinct().groupBy(choice.alias("task")).agg(F.count("*").alias("n"))


@query
def task_source_text(spark, d):
    rows = table(spark, d, "task_specs")
    return rows.select("spec_id", F.concat(*[F.coalesce(c, F.lit("")) for c in ("prefix_text", "visual_text", "suffix_text")]).alias("source_text"))


@query
def continuation_lengths(spark, d):
    """Continuation from the first boundary on: lengths of what stands before, is shown, and follows."""
    rows = docs(spark, d).where(F.length("text") >= 100).select("doc_id", "text", X.safe_boundaries(F.col("text")).alias("b")).where(F.size("b") >= 3)
    start = F.element_at("b", 2)
    rows = rows.select("doc_id", "text", start.alias("start"), F.coalesce(F.array_min(F.filter(F.slice("b", 3, 1 << 30), lambda x: x - start >= 300)), F.array_max("b")).alias("end"))
    cut = lambda a, n: F.length(X.strip(F.substring(F.col("text"), a, n)))
    return rows.select("doc_id", cut(F.lit(1), F.col("start")).alias("prefix_len"), cut(F.col("start") + 1, F.col("end") - F.col("start")).alias("visual_len"), cut(F.col("end") + 1, F.length("text")).alias("suffix_len"))


@query
def style_sample(spark, d):
    return docs(spark, d).select("doc_id", udfs.sample_style()(F.col("doc_id").cast("string"), F.lit(0)).alias("s")).select("doc_id", "s.*")


@query
def stable_seeds(spark, d):
    return docs(spark, d).select("doc_id", udfs.stable_seed(F.col("doc_id").cast("string"), F.lit(0)).alias("seed"))


def _sequences(spark, d) -> DataFrame:
    rows = table(spark, d, "task_specs").select("spec_id", "task_type", F.coalesce("is_text_only", F.lit(False)).alias("is_text_only"), F.coalesce("prefix_text", F.lit("")).alias("prefix_text"), F.coalesce("target_text", F.lit("")).alias("target_text"))
    ids = lambda c: S.code_points(F.col(c), 1000)
    seq = S.task_sequence(F.col("task_type"), F.col("is_text_only"), ids("prefix_text"), ids("target_text"), F.lit(64))
    return rows.select("spec_id", "task_type", S.truncate(seq, 1024).alias("s")).select("spec_id", "task_type", "s.*")


@query
def task_sequences(spark, d):
    return _sequences(spark, d).select("spec_id", "ids", "labels")


@query
def pad_batches(spark, d):
    """Batches of eight by spec_id: every row's padded ids, labels and mask."""
    rows = N.with_position(_sequences(spark, d), ["spec_id"]).withColumn("batch", F.floor(F.col("pos") / 8).cast("int"))
    return S.pad_batches(rows).select("spec_id", "batch", "input_ids", "padded_labels", "attention_mask")


@query
def vision_alignment(spark, d):
    return _sequences(spark, d).groupBy("task_type", S.aligned(F.col("ids"), F.lit(8), F.lit(8)).alias("aligned")).agg(F.count("*").alias("n"))


@query
def pad_batch_stats(spark, d):
    """Batches of eight by spec_id: the longest row, padded cells and learned labels of each."""
    rows = N.with_position(_sequences(spark, d), ["spec_id"]).withColumn("batch", F.floor(F.col("pos") / 8).cast("int"))
    padded = S.pad_batches(rows)
    return padded.groupBy("batch").agg(
        F.max(F.size("input_ids")).alias("max_len"), F.sum(F.size("input_ids") - F.size("ids")).alias("padding"), F.sum(F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n_tokens"), F.sum(S.label_count(F.col("padded_labels"))).alias("n_labels")
    )


@query
def cpt_first_answer(spark, d):
    return table(spark, d, "chat_rows").select("chat_id", S.first_answer(F.col("messages")).alias("caption"), F.coalesce(F.size("images") > 0, F.lit(False)).alias("has_image"))


@query
def image_answer_sequence(spark, d):
    rows = table(spark, d, "chat_rows").select("chat_id", S.first_answer(F.col("messages")).alias("caption"), "images").where("caption is not null and size(images) > 0")
    seq = S.image_answer(S.code_points(F.col("caption"), 1000), F.lit(64), 256)
    return rows.select("chat_id", seq.alias("s")).where("s is not null").select("chat_id", "s.*")


@query
def chatml_sequence(spark, d):
    rows = table(spark, d, "chat_rows").select("chat_id", "messages", F.when(F.size("images") > 0, 64).otherwise(0).alias("nt"))
    seq = S.chat_sequence(F.col("messages"), F.col("nt"), lambda c: S.code_points(c, 1000))
    return rows.select("chat_id", seq.alias("s")).select("chat_id", "s.*")


@query
def text_only_sequence(spark, d):
    rows = docs(spark, d).select("doc_id", X.strip(F.col("text")).alias("text"))
    seq = S.text_sample(S.code_points(F.col("text"), 1000), F.col("text"), 512)
    return rows.select("doc_id", seq.alias("s")).where("s is not null").select("doc_id", "s.*")


@query
def placeholder_expansion(spark, d):
    rows = table(spark, d, "chat_rows").select("chat_id", F.explode("messages").alias("m")).where("m.role = 'user' and m.content is not null")
    return rows.select("chat_id", "m.content", S.expand_placeholders(F.col("m.content"), F.array(F.lit(3))).alias("expanded")).distinct()


# -- vocabularies ------------------------------------------------------------------------------------------------


@query
def doc_to_vocab(spark, d):
    return V.characters(docs(spark, d))


def _vocabulary(spark, d) -> DataFrame:
    """The characters of the labelled passages, most frequent first."""
    found = V.characters(table(spark, d, "area_examples"))
    return found.select(F.col("ch").alias("token"), (F.row_number().over(Window.orderBy(F.desc("n"), "ch")) - 1).cast("int").alias("id"))


@query
def vocabulary_file(spark, d):
    """A vocabulary written as one token a line and read back: the same ids."""
    path = work_path(spark, "vocabulary")
    K.write_vocabulary(_vocabulary(spark, d), path)
    return V.from_lines(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


@query
def vocab_new_chars(spark, d):
    return V.new_characters(V.characters(docs(spark, d)), _vocabulary(spark, d)).select("ch", "n")


@query
def vocab_coverage(spark, d):
    return V.coverage(V.characters(docs(spark, d)), _vocabulary(spark, d))


@query
def vocab_extended(spark, d):
    return V.extended(_vocabulary(spark, d), V.characters(docs(spark, d)))


@query
def char_tokenize(spark, d):
    return V.encode_rows(docs(spark, d).where("text is not null"), _vocabulary(spark, d), "doc_id", "text")


@query
def char_round_trip(spark, d):
    """Encoded and decoded with the extended vocabulary: nothing is lost."""
    found = V.extended(_vocabulary(spark, d), V.characters(docs(spark, d)))
    coded = V.encode_rows(docs(spark, d).where("text is not null"), found, "doc_id", "text")
    return V.decode_rows(coded, found, "doc_id", "ids").withColumnRenamed("decoded", "text")


# -- layout ------------------------------------------------------------------------------------------------------


def _measured(spark, d) -> DataFrame:
    chars = F.length("text")
    rows = docs(spark, d).where(chars > 0).select("doc_id", chars.alias("chars"), (F.pmod(F.col("doc_id"), F.lit(15)) + 18).cast("int").alias("font"))
    return rows.withColumns({"content_w": F.least(F.col("chars") * 9, F.lit(900)).cast("int"), "content_h": (F.ceil(F.col("chars") * 9 / 900) * F.col("font")).cast("int")})


@query
def canvas_size(spark, d):
    c = L.canvas_size(F.col("content_w"), F.col("content_h"), *[F.lit(n) for n in (24, 24, 32, 32)])
    return _measured(spark, d).select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query
def bucket_choice(spark, d):
    """A page's height bucket, or the reason why it must be split."""
    h = L.choose_bucket(L.required_height(F.col("content_h"), F.lit(16), F.lit(0)), L.HEIGHTS)
    return _measured(spark, d).select("doc_id", h.alias("height"), F.when(h.isNull(), "needs_split").alias("reject_reason"))


@query
def width_candidates(spark, d):
    kinds = pages(spark, d).where("blocks is not null").select("id", F.exists("blocks", lambda b: b["kind"] == "table").alias("t"), F.exists("blocks", lambda b: b["kind"] == "math_display").alias("m"))
    return kinds.select("id", F.array_join(L.width_candidates(F.col("t"), F.col("m")).cast("array<string>"), ",").alias("widths")).distinct()


@query
def smart_resize(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 3000 + 1).cast("int").alias("h"), (F.col("l_orderkey") % 4000 + 1).cast("int").alias("w")).distinct()
    return rows.select("h", "w", L.smart_resize(F.col("h"), F.col("w")).alias("s")).select("h", "w", F.col("s.height").alias("height"), F.col("s.width").alias("width"))


@query
def coordinates_2d(spark, d):
    grids = spark.createDataFrame([(2, 8), (4, 16), (8, 16), (16, 32), (6, 24)], "grid_h int, grid_w int")
    cells = grids.select("grid_h", "grid_w", F.explode(L.coordinates(F.col("grid_h"), F.col("grid_w"))).alias("c"))
    return cells.select("grid_h", "grid_w", F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))


@query
def font_stacks(spark, d):
    return docs(spark, d).where("text is not null").groupBy(L.font_stack(F.col("text"), F.lit("serif")).alias("stack")).agg(F.count("*").alias("n"))


@query
def bucket_batches(spark, d):
    c = L.canvas_size(F.col("content_w"), F.col("content_h"), *[F.lit(n) for n in (24, 24, 32, 32)])
    rows = _measured(spark, d).select("doc_id", c.alias("c")).select("doc_id", "c.grid_h", "c.grid_w")
    return D.bucket_batches(rows, 4, "doc_id").select("doc_id", "grid_h", "grid_w", "batch")


# -- schedules ---------------------------------------------------------------------------------------------------


@query
def lr_schedule(spark, d):
    steps = spark.range(0, 1001).select(F.col("id").alias("step"))
    return steps.select("step", *[F.round(C.lr_factor(F.col("step"), 1000, 100, k, 0.1), 9).alias(k) for k in ("cosine", "linear", "constant")])


@query
def curriculum_phase(spark, d):
    steps = spark.range(0, 200_000, 500).select(F.col("id").alias("step"))
    return steps.select("step", C.curriculum(F.col("step")).alias("p")).select("step", "p.*")


@query
def steps_per_epoch(spark, d):
    n = docs(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(*[F.lit(b) for b in (32, 256, 512)])).alias("batch"), "n").select("batch", C.steps_per_epoch(F.col("n"), 1).alias("samples"), F.ceil(F.col("n") / F.col("batch")).alias("steps"))


# -- quality -----------------------------------------------------------------------------------------------------


@query
def validate_records(spark, d):
    rows = pages(spark, d).select("id", "target_text").distinct()
    return rows.select("id", F.explode(Q.issues(F.col("id"), F.col("target_text"))).alias("issue"))


@query
def validate_manifest(spark, d):
    return Q.validate(pages(spark, d), "id", "target_text", "source").withColumn("avg_len", F.round("avg_len", 6))


@query
def issue_top20(spark, d):
    return Q.top_issues(pages(spark, d), "id", "target_text")


@query
def percentiles_linear(spark, d):
    return Q.percentiles(table(spark, d, "events"), "event_type", "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean", "most")])


@query
def p95_floor(spark, d):
    return Q.floor_percentile(table(spark, d, "events"), "event_type", "value")


@query
def size_distribution(spark, d):
    sized = _measured(spark, d).select(L.choose_bucket(F.col("content_h"), L.HEIGHTS).alias("bucket"))
    return Q.distribution(sized, "bucket").withColumn("share", F.round("share", 9))


@query
def stage_throughput(spark, d):
    rows = table(spark, d, "events").where("value > 0")
    return Q.throughput(rows, "event_type", "value").select("event_type", F.round("samples_per_s", 6).alias("samples_per_s"))


@query
def scaling_efficiency(spark, d):
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 8 + 1).alias("workers")).agg(F.count("*").cast("double").alias("throughput"))
    return Q.scaling(runs, "workers", "throughput").select("workers", F.round("speedup", 9).alias("speedup"), F.round("efficiency", 9).alias("efficiency"))


@query
def recycle_rows(spark, d):
    return C.recycled(table(spark, d, "area_examples").select("example_id", "area"), 500, "example_id").groupBy("example_id", "area").agg(F.count("*").alias("n"))


@query
def retention(spark, d):
    return K.keep_last(docs(spark, d).select("doc_id", "added_at").where("added_at is not null"), "doc_id", 5).select("doc_id")


@query
def parse_cases(spark, d):
    """Fixed texts of every form through the parser: kinds and targets of the blocks. The SQL holds results worked out by hand."""
    cases = [
        "One.\n\nTwo $x=1$ costs $5.", "A\n$$a+b$$\nB \\(c\\)", "\\begin{align*}x\\end{align*}", "[latex]y^2[/latex] tail", "| a | b |\n|---|---|\n| 1 | 2 |\nafter", "<p>One <b>two</b></p><table><tr><td>a</td><td>b</td></tr></table>",
        "<div>only &amp; text</div>", "\\textbf{bold \\emph{in}} out", "price $10 and $20", "a | b\nno rule", "", "\\[x\\] \\[y\\]",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id int, text string").withColumn("subject", F.lit(None).cast("string"))
    found = P.document_blocks(rows, guarded=True).select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    return found.select("doc_id", "pos", F.col("b.kind").alias("kind"), P.block_target(F.col("b")).alias("target"))


# -- streams -----------------------------------------------------------------------------------------------------


@query
def stream_dedup(spark, d):
    """Documents as a stream of files; the first of equal texts is kept, and the results are a table."""
    source = docs(spark, d)
    path = os.path.join(d, "document[s].parquet")  # a pattern, so that a file is taken as well as a folder
    stream = I.first_copy_stream(I.document_stream(spark, path, source.schema))
    base = work_path(spark, "stream")
    I.ingest(stream.select("doc_id", "sha1"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"), F.count_distinct("sha1").alias("n_distinct"))


@query
def stream_windows(spark, d):
    """Events as a stream: counts of each type and day that are final, an hour for late ones."""
    schema = table(spark, d, "events").schema
    stream = I.document_stream(spark, os.path.join(d, "event[s].parquet"), schema).withColumn("ts", F.col("ts").cast("timestamp"))
    base = work_path(spark, "windows")
    I.ingest(I.counted_by_window(stream, "ts", "event_type"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("window.start").cast("date").alias("day"), "event_type", "n")
