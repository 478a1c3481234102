"""Validation of records and statistics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import count_of
from pagemill.operators.positions import with_group_position


def issues(key: Column, text: Column) -> Column:
    """What is wrong with a record: array of strings, empty if nothing is."""
    some = F.length(text) > 0
    stray = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", ""))
    n = lambda s: count_of(text, s)
    round_, square = n("\\(") - n("\\|"), n("\\[")
    named = lambda name, a, b: F.concat(F.lit(f"{name}: "), a.cast("string"), F.lit(" vs "), b.cast("string"))
    found = F.array(
        F.when(F.coalesce(key, F.lit("")) == "", "missing id"),
        F.when(F.coalesce(text, F.lit("")) == "", "empty target_text"),
        F.when(some & (stray > 0), F.concat(F.lit("control_chars="), stray.cast("string"))),
        F.when(some & (round_ != n("\\)")), named("latex_paren_mismatch", round_, n("\\)"))),
        F.when(some & (square != n("\\]")), named("latex_bracket_mismatch", square, n("\\]"))),
    )
    return F.array_compact(found)


def validate(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """Per group: rows, valid ones, empty texts, and text lengths."""
    checked = df.select(group, issues(F.col(key).cast("string"), F.col(text)).alias("issues"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    return checked.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(F.size("issues") == 0).alias("valid"),
        F.count_if(F.size("issues") > 0).alias("invalid"),
        F.count_if(F.array_contains("issues", "empty target_text")).alias("empty_text"),
        F.avg("n").alias("avg_len"),
        F.max("n").alias("max_len"),
        F.min("n").alias("min_len"),
    )


def top_issues(df: DataFrame, key: str, text: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent issues, ties by their text."""
    each = df.select(F.explode(issues(F.col(key).cast("string"), F.col(text))).alias("issue"))
    return each.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(k)


def _ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    return with_group_position(df.where(F.col(value).isNotNull()).select(group, value), [group], [value])


def percentiles(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact, with linear interpolation at (n - 1) p, from positions: no group is gathered, only the values beside the ranks."""
    last = F.col("pos_of") - 1
    out = []
    for p in shares:
        at = last * F.lit(p)
        low = F.floor(at)
        near = F.when(F.col("pos") == low, F.col(value) * (1 - (at - low))).when(F.col("pos") == low + 1, F.col(value) * (at - low))
        out.append(F.sum(near).alias(f"p{int(p * 100)}"))
    return _ranked(df, group, value).groupBy(group).agg(*out, F.avg(value).alias("mean"), F.max(value).alias("most"))


def floor_percentile(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """The value at index floor(share * n), clamped to the last; from positions, too."""
    at = F.least(F.floor(F.col("pos_of") * F.lit(share)), F.col("pos_of") - 1)
    return _ranked(df, group, value).where(F.col("pos") == at).select(group, F.col(value).alias("p_floor"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Counts of each value and their shares."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def scaling(df: DataFrame, workers: str, throughput: str) -> DataFrame:
    """Throughput against that of the first (least) number of workers, and per worker."""
    base = F.first(throughput).over(Window.orderBy(workers))  # a row for each configuration
    first = F.first(workers).over(Window.orderBy(workers))
    return df.select(workers, throughput, (F.col(throughput) / base).alias("speedup"), (F.col(throughput) * first / (base * F.col(workers))).alias("efficiency"))


def throughput(df: DataFrame, group: str, millis: str, tokens: str | None = None) -> DataFrame:
    """Samples a second at the mean latency, and tokens a second where they are known."""
    out = [(F.lit(1000.0) / F.avg(millis)).alias("samples_per_s")]
    if tokens:
        out.append((F.sum(tokens) * 1000.0 / F.sum(millis)).alias("tokens_per_s"))
    return df.groupBy(group).agg(*out)
