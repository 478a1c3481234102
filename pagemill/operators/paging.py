"""Blocks to pages: targets, costs, the greedy fold over a budget, records and flags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.blocks import parse, within
from pagemill.schemas import BLOCK, BLOCK_ARROW
from pagemill.session import once, ship


def part_target(p: Column) -> Column:
    formula = F.coalesce(F.when(p["target"] != "", p["target"]), F.concat(F.lit("\\("), F.coalesce(p["tex"], F.lit("")), F.lit("\\)")))
    return F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).when(p["kind"] == "math_inline", formula).otherwise("")


def block_target(b: Column) -> Column:
    """What a block contributes to its page's target."""
    cells = F.array_join(F.transform(F.coalesce(b["rows"], F.array()), lambda row: F.array_join(row, "\t")), "\n")
    own = F.when(b["target"] != "", b["target"])
    return X.strip(
        F.when(b["kind"] == "paragraph", F.array_join(F.transform(F.coalesce(b["parts"], F.array()), part_target), ""))
        .when(b["kind"] == "math_display", F.coalesce(own, F.concat(F.lit("\\["), F.coalesce(b["tex"], F.lit("")), F.lit("\\]"))))
        .when(b["kind"] == "table", F.coalesce(own, cells))
        .otherwise("")
    )


def join_targets(blocks: Column) -> Column:
    return X.strip(F.array_join(F.filter(F.transform(blocks, block_target), lambda t: t != ""), "\n"))


def block_cost(b: Column) -> Column:
    """A page's budget is spent by characters, a formula's weighted length, or rows."""
    formula = F.floor(F.length(F.coalesce(b["tex"], F.lit(""))).cast("double") * F.lit(1.7)).cast("int")
    rows = F.coalesce(F.size(b["rows"]), F.lit(0))
    return (
        F.when(b["kind"] == "paragraph", F.greatest(F.lit(1), F.length(block_target(b))))
        .when(b["kind"] == "math_display", F.greatest(F.lit(140), formula))
        .when(b["kind"] == "table", F.greatest(F.lit(180), F.greatest(rows, F.lit(0)) * 85))
        .otherwise(50)
    )


def page_numbers(costs: Column, budget: int = 950) -> Column:
    """The page of each cost: a page is closed when the next block would exceed the budget; an oversized one stands alone."""

    def step(state: Column, cost: Column) -> Column:
        opens = (state["used"] > 0) & (state["used"] + cost > budget)
        page = state["page"] + F.when(opens, 1).otherwise(0)
        used = F.when(opens, cost).otherwise(state["used"] + cost)
        return F.struct(page.alias("page"), used.cast("int").alias("used"), F.array_append(state["out"], page).alias("out"))

    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(costs, start, step, lambda s: s["out"])


def block_flags(blocks: Column) -> Column:
    """1 with a formula, 2 with a table; told from the blocks."""
    inline = lambda b: F.exists(F.coalesce(b["parts"], F.array()), lambda p: p["kind"] == "math_inline")
    math = F.exists(blocks, lambda b: (b["kind"] == "math_display") | inline(b))
    tables = F.exists(blocks, lambda b: b["kind"] == "table")
    return F.when(math, 1).otherwise(0) + F.when(tables, 2).otherwise(0)


def document_blocks(docs: DataFrame, limit: int = 420, structured_html: bool = True, guarded: bool = False) -> DataFrame:
    """doc_id, subject, blocks of (doc_id, subject, text); the blocks of a null or empty text are an empty array.

    ``guarded``: paragraphs whose target is beyond the limit are read again before anything is packed.
    """
    ship(docs.sparkSession)
    prepared = docs.select("doc_id", "subject", X.normalize(F.col("text"), collapse=False).alias("text"))
    schema = f"doc_id {prepared.schema['doc_id'].dataType.simpleString()}, subject string, blocks array<{BLOCK}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [parse(t, limit, structured_html) for t in batch.column(2).to_pylist()]
            if guarded:
                blocks = [within(b, limit) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.list_(BLOCK_ARROW))], names=["doc_id", "subject", "blocks"])

    return prepared.mapInArrow(run, schema)


def document_pages(docs: DataFrame, budget: int = 950, limit: int = 420, structured_html: bool = True) -> DataFrame:
    """Page records of (doc_id, subject, text): one row for each page that has a target. No shuffle.

    A page's index counts the pages left out, too; the subject of a page is never null.
    """
    parsed = document_blocks(docs, limit, structured_html, guarded=True)
    numbered = parsed.withColumn("page", page_numbers(F.transform("blocks", block_cost), budget))
    pages = numbered.select("doc_id", "subject", "blocks", "page", F.explode(F.array_distinct("page")).alias("page_index"))
    pages = pages.withColumn("blocks", F.expr("transform(filter(arrays_zip(blocks, page), x -> x.page = page_index), x -> x.blocks)"))
    records = once(pages, "target_text", join_targets(F.col("blocks"))).where("target_text <> ''")
    records = records.select(
        F.format_string("%s-p%05d", F.col("doc_id").cast("string"), "page_index").alias("id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "page_index",
        F.coalesce("subject", F.lit("")).alias("subject"),
        "blocks",
        "target_text",
        block_flags(F.col("blocks")).alias("flags"),
    )
    return records.select("id", "doc_id", "page_index", "subject", "blocks", "target_text", (F.col("flags").bitwiseAND(1) > 0).alias("has_math"), (F.col("flags").bitwiseAND(2) > 0).alias("has_table"), "flags")


def compact(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("id").alias("i"), F.col("target_text").alias("t"), F.col("subject").alias("s"), F.col("flags").alias("f"))


def plain_pages(docs: DataFrame, budget: int = 950, limit: int = 420) -> DataFrame:
    """Compact pages of plain text (no formulas, tables or tags are looked for): all of it in Spark's own functions."""
    chunked = docs.select("doc_id", "subject", X.paragraph_chunks(X.normalize(F.col("text"), collapse=False), limit).alias("chunks"))
    numbered = chunked.withColumn("page", page_numbers(F.transform("chunks", lambda c: F.greatest(F.lit(1), F.length(c))), budget))  # no filter: it would be pushed down and fold twice
    pages = numbered.select("*", F.explode(F.array_distinct("page")).alias("page_index"))
    text = X.strip(F.expr("array_join(transform(filter(arrays_zip(chunks, page), x -> x.page = page_index), x -> x.chunks), '\n')"))
    out = once(pages, "t", text).where("t <> ''")
    return out.select(F.format_string("%s-p%05d", F.col("doc_id").cast("string"), "page_index").alias("i"), "t", F.coalesce("subject", F.lit("")).alias("s"), X.text_flags(F.col("t")).alias("f"))


def block_html(b: Column) -> Column:
    """A block as escaped HTML."""
    e = lambda c: X.escape_html(F.coalesce(c, F.lit("")))
    span = lambda kind, tex: F.concat(F.lit(f'<span class="math-render math-{kind}" data-tex="'), e(tex), F.lit('">'), e(tex), F.lit("</span>"))
    parts = F.array_join(F.transform(F.coalesce(b["parts"], F.array()), lambda p: F.when(p["kind"] == "math_inline", span("inline", p["tex"])).otherwise(e(p["text"]))), "")
    row = lambda r: F.concat(F.lit("<tr>\n"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), e(c), F.lit("</td>\n"))), ""), F.lit("</tr>"))
    rows = F.coalesce(b["rows"], F.array())
    return (
        F.when(b["kind"] == "paragraph", F.concat(F.lit("<p>"), parts, F.lit("</p>")))
        .when(b["kind"] == "math_display", F.concat(F.lit('<div class="math-display-wrapper">'), span("display", b["tex"]), F.lit("</div>")))
        .when((b["kind"] == "table") & (F.size(rows) > 0), F.concat(F.lit("<table><tbody>\n"), F.array_join(F.transform(rows, row), "\n"), F.lit("\n</tbody></table>")))
        .otherwise("")
    )


def page_html(blocks: Column, width: int, height: int, css: str = "") -> Column:
    """A whole page to be rendered."""
    body = F.array_join(F.filter(F.transform(blocks, block_html), lambda h: h != ""), "\n")
    return F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>body{{width:{width}px;height:{height}px;margin:0}}{css}</style></head><body>'), body, F.lit("</body></html>"))
