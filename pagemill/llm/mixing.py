"""Problem 8: sources mixed to target shares of tokens by Poisson replication.

Each source has a mean repetition rate that gives it its share. A document's number of copies is drawn by
inverting, at a uniform number hashed from its id, a Poisson distribution that is cut off at the source's cap and
has that mean. So every task decides by itself, and the same seed gives the same mixture. As the numbers are fixed,
a source's tokens only grow with its rate, and the rates are calibrated to the tokens they really give. The copies
are then put into a global order by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagemill.llm.tokenizer import VOCABULARY, count_tokens
from pagemill.session import materialize


def source_name(c: Column) -> Column:
    """A source without differences of case, hyphens, blanks and underscores; null where nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\s\-_]+", "_"), r"^_+|_+$", "")
    return F.when(name != "", name)


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson variable of that rate, cut off at ``cap``."""
    p, mean, below = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * max(0.0, 1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The rate whose capped mean is ``mean``; infinite where the cap itself is asked for."""
    if mean <= 0:
        return 0.0
    if mean >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 600:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < mean else (low, middle)
    return high


def steps(rate: float, cap: int) -> list[float]:
    """Where the number of copies rises: u >= steps[k] gives more than k copies, ``cap`` at most."""
    if math.isinf(rate):
        return [0.0] * cap
    out, p, below = [], math.exp(-rate), 0.0
    for k in range(cap):
        below += p
        out.append(min(below, 1.0))
        p *= rate / (k + 1)
    return out


def plan(targets: list[Row], tokens: dict[str, int], total: float | None = None) -> list[dict]:
    """The rate of each source. Without ``total`` the mixture is as large as the caps let every share be exact.

    Sources that are absent get nothing, and their share is spread over the others in proportion; with a ``total``
    that a cap cannot reach, a source gives what it can.
    """
    present = {t["source"]: t for t in targets if tokens.get(t["source"], 0) > 0 and t["target_share"] and t["target_share"] > 0 and (t["max_repeats"] or 0) > 0}
    whole = sum(t["target_share"] for t in present.values())
    if total is None:
        total = min((t["max_repeats"] * tokens[s] * whole / t["target_share"] for s, t in present.items()), default=0.0)
    out = []
    for t in targets:
        s = t["source"]
        share = t["target_share"] / whole if s in present else 0.0
        mean = min(share * total / tokens[s], t["max_repeats"]) if s in present else 0.0
        cap = int(t["max_repeats"] or 0)
        rate = rate_for(mean, cap) if cap else 0.0
        out.append({"source": s, "target_share": t["target_share"], "share": share, "mean": mean, "rate": rate, "steps": steps(rate, cap) if mean > 0 else [1.0] * 0})
    return out


def _calibrated(sized: DataFrame, planned: list[dict], caps: dict[str, int], tokens: dict[str, int], u: Column, rounds: int = 2, points: int = 9, width: float = 0.25) -> None:
    """Moves each finite rate, in place, to the one of nearby rates whose drawn tokens come closest to the plan's."""
    spark = sized.sparkSession
    open_ = [p for p in planned if p["mean"] > 0 and not math.isinf(p["rate"])]
    for _ in range(rounds if open_ else 0):
        tried = {p["source"]: [p["rate"] * (1 + width * (2 * k / (points - 1) - 1)) for k in range(points)] for p in open_}
        rows = [(s, [steps(r, caps[s]) for r in rates]) for s, rates in tried.items()]
        table = spark.createDataFrame(rows, "source string, tried array<array<double>>")
        each = sized.select("source", "n_tokens", u.alias("u")).join(F.broadcast(table), "source")  # a row for each source
        each = each.select("source", "n_tokens", F.posexplode(F.expr("transform(tried, t -> size(filter(t, s -> u >= s)))")).alias("k", "n"))
        got = {(r["source"], r["k"]): r["g"] for r in each.groupBy("source", "k").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("g")).collect()}
        for p in open_:
            s = p["source"]
            best = min(range(points), key=lambda k: (abs((got.get((s, k)) or 0) - p["mean"] * tokens[s]), k))
            p["rate"] = tried[s][best]
            p["steps"] = steps(p["rate"], caps[s])
        width = 2 * width / (points - 1)


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture: order_key, doc_id, copy, source, n_tokens, text, in global random order; shares: one row for each target).

    Sources are compared by ``source_name``. Documents of sources that are not listed, of null source, and null or
    empty texts (no tokens) are not part of any mixture. Rows that repeat an id get the same number of copies.
    ``targets`` must be a table of at most 10,000 sources (ValueError), since the plan is made in the driver; a source
    listed twice counts by its first row in order of share. Empty tables give empty results.
    """
    spark = documents.sparkSession
    listed = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    rows = listed.orderBy(F.desc("target_share"), "source").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many sources")
    rows = list({r["source"]: r for r in reversed(rows)}.values())
    named = documents.select(F.col(f"`{id_col}`").alias("doc_id"), source_name(F.col(f"`{source_col}`")).alias("source"), F.col(f"`{text_col}`").alias("text"))
    known = named.where(F.col("source").isin([r["source"] for r in rows]) & (F.length("text") > 0))
    sized = materialize(count_tokens(known, "text", ["doc_id", "source", "text"], vocabulary=vocabulary), "mix-sized")
    tokens = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    planned = plan(rows, tokens, total)
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    _calibrated(sized, planned, {r["source"]: int(r["max_repeats"] or 0) for r in rows}, tokens, u)
    table = spark.createDataFrame([(p["source"], p["target_share"], float(p["share"]), float(p["mean"]), p["steps"]) for p in planned], "source string, target_share double, reachable_share double, mean_repeats double, steps array<double>")
    drawn = sized.join(F.broadcast(table), "source").withColumn("u", u)  # at most 10,000 small rows
    copies = drawn.withColumn("n", F.expr("size(filter(steps, s -> u >= s))")).where("n > 0")
    mixture = copies.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("copy"), "source", "n_tokens", "text")
    mixture = mixture.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("order_key"), "*")
    used = copies.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("used_tokens"), F.count("*").alias("n_documents"), F.sum("n").alias("n_copies"), F.max("n").alias("most_copies"))
    share = table.drop("steps").join(used, "source", "left").na.fill(0, ["used_tokens", "n_documents", "n_copies", "most_copies"])
    whole = share.agg(F.sum("used_tokens").alias("whole"))
    shares = share.crossJoin(F.broadcast(whole)).select("source", "target_share", "reachable_share", "mean_repeats", "n_documents", "n_copies", "most_copies", "used_tokens", F.coalesce(F.try_divide(F.col("used_tokens"), F.col("whole")), F.lit(0.0)).alias("actual_share"))
    return mixture.orderBy("order_key", "doc_id", "copy"), shares
