"""Token sequences with labels as array columns: tasks, truncation, chat, padding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Special:
    """Ids with a meaning of their own."""

    pad: int = 0
    eos: int = 1
    unk: int = 2
    vision_start: int = 5
    vision_end: int = 6
    image_pad: int = 7
    ignore: int = -100


def code_points(c: Column, modulus: int | None = None) -> Column:
    """A vocabulary-free tokenizer: each character's code point (by a modulus, as test tokenizers do)."""
    ids = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    ids = F.when(F.length(c) > 0, ids).otherwise(F.array().cast("array<bigint>"))
    return ids if modulus is None else F.transform(ids, lambda i: i % modulus)


def _longs(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def vision_prefix(n: Column, s: Special = Special()) -> Column:
    return F.concat(_longs(s.vision_start), F.array_repeat(F.lit(s.image_pad).cast("bigint"), n.cast("int")), _longs(s.vision_end))


def _ignored(size: Column, s: Special) -> Column:
    return F.array_repeat(F.lit(s.ignore).cast("bigint"), size.cast("int"))


def pair(context: Column, answer: Column, s: Special = Special()) -> Column:
    """(ids, labels): the context is masked, the answer and the end are learned."""
    learned = F.concat(answer, _longs(s.eos))
    return F.struct(F.concat(context, learned).alias("ids"), F.concat(_ignored(F.size(context), s), learned).alias("labels"))


def task_sequence(task_type: Column, text_only: Column, context: Column, answer: Column, visual_tokens: Column, s: Special = Special()) -> Column:
    """Full OCR sees the image, continuation and reconstruction also their context before it, replay nothing."""
    image = vision_prefix(visual_tokens, s)
    seen = F.when(task_type.isin("optical_continuation", "span_reconstruction"), F.concat(context, image)).otherwise(image)
    return F.when(text_only, pair(F.array().cast("array<bigint>"), answer, s)).otherwise(pair(seen, answer, s))


def truncate(sequence: Column, longest: int) -> Column:
    """Both arrays cut; the end may be lost."""
    return F.struct(F.slice(sequence["ids"], 1, longest).alias("ids"), F.slice(sequence["labels"], 1, longest).alias("labels"))


def image_answer(answer: Column, visual_tokens: Column, longest: int, least: int = 4, s: Special = Special()) -> Column:
    """An image's answer, cut so that its end is kept; null if fewer than ``least`` ids would be left for it."""
    room = F.lit(longest) - visual_tokens - 2 - 1
    return F.when(room >= least, pair(vision_prefix(visual_tokens, s), F.slice(answer, F.lit(1), F.greatest(room, F.lit(1)).cast("int")), s))


def text_sample(ids: Column, text: Column, longest: int, s: Special = Special()) -> Column:
    """A text without an image; null under 20 characters or 4 ids."""
    cut = F.slice(ids, 1, longest - 1)
    return F.when((F.length(text) >= 20) & (F.size(cut) >= 4), pair(F.array().cast("array<bigint>"), cut, s))


def first_answer(messages: Column) -> Column:
    """The first assistant turn, stripped; null where it is missing or blank, even if a later one is not."""
    first = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(1))["content"]
    return F.when(F.trim(first) != "", F.trim(first))


def chat_sequence(messages: Column, visual_tokens: Column, encode, system: str = "You are a helpful assistant.", longest: int = 4096, least: int = 4, s: Special = Special()) -> Column:
    """A chat in ChatML: a fixed system turn, user turns masked, assistant contents learned (their header and end are not).

    ``encode`` makes ids of a string column. Image markers are removed from user turns; the image's ids stand in the
    first turn if that is a user's with any text. Other roles and blank turns are passed over. Null under ``least`` ids.
    """
    empty = F.array().cast("array<bigint>")
    text = lambda t: encode(F.lit(t))
    masked = lambda ids: F.struct(ids.alias("ids"), _ignored(F.size(ids), s).alias("labels"))
    join = lambda *xs: F.struct(F.concat(*[x["ids"] for x in xs]).alias("ids"), F.concat(*[x["labels"] for x in xs]).alias("labels"))
    end = masked(text("<|im_end|>\n"))

    def turn(m: Column, k: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        asked = F.trim(F.replace(F.replace(content, F.lit("<image>\n"), F.lit("")), F.lit("<image>"), F.lit("")))
        said = encode(F.trim(content))
        image = F.when((k == 0) & (visual_tokens > 0), vision_prefix(visual_tokens, s)).otherwise(empty)
        user = join(masked(F.concat(text("<|im_start|>user\n"), image, encode(asked))), end)
        answer = join(masked(text("<|im_start|>assistant\n")), F.struct(said.alias("ids"), said.alias("labels")), end)
        nothing = F.struct(empty.alias("ids"), empty.alias("labels"))
        return F.when((m["role"] == "user") & (asked != ""), user).when((m["role"] == "assistant") & (F.trim(content) != ""), answer).otherwise(nothing)

    turns = F.transform(F.coalesce(messages, F.array()), turn)
    head = masked(text(f"<|im_start|>system\n{system}<|im_end|>\n"))
    ids = F.concat(head["ids"], F.flatten(F.transform(turns, lambda t: t["ids"])))
    labels = F.concat(head["labels"], F.flatten(F.transform(turns, lambda t: t["labels"])))
    whole = truncate(F.struct(ids.alias("ids"), labels.alias("labels")), longest)
    return F.when(F.size(whole["ids"]) >= least, whole)


def pad_batches(rows: DataFrame, batch: str = "batch", s: Special = Special()) -> DataFrame:
    """ids, labels and attention mask padded on the right to the batch's longest row; one shuffle by batch."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    short = (longest - F.size("ids")).cast("int")
    fill = lambda v: F.array_repeat(F.lit(v).cast("bigint"), short)
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size("ids")), fill(0))
    return rows.withColumns({"input_ids": F.concat("ids", fill(s.pad)), "padded_labels": F.concat("labels", fill(s.ignore)), "attention_mask": mask})


def label_count(labels: Column, s: Special = Special()) -> Column:
    return F.size(F.filter(labels, lambda x: x != s.ignore))


def aligned(ids: Column, grid_h: Column, grid_w: Column, s: Special = Special()) -> Column:
    """Whether the image's placeholders are as many as its cells."""
    return F.size(F.filter(ids, lambda x: x == s.image_pad)) == grid_h * grid_w


def expand_placeholders(text: Column, counts: Column, marker: str = "<image>") -> Column:
    """The k-th marker repeated counts[k] times; null where markers and counts differ in number."""
    parts = F.split(text, "\\Q" + marker + "\\E", -1)
    filled = F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.repeat(F.lit(marker), F.get(counts, k).cast("int")), F.lit(""))))
    return F.when(F.size(parts) - 1 == F.size(counts), F.array_join(filled, ""))
