"""Learning-rate schedules, curriculum phases and step counts as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phases of the curriculum (last step, shares of difficulty).
PHASES = ((50_000, 0.80, 0.18, 0.02), (100_000, 0.55, 0.35, 0.10), (None, 0.40, 0.40, 0.20))


def lr_factor(step: Column, total: int, warmup: int, kind: str = "cosine", least: float = 0.0) -> Column:
    """A linear rise, then cosine, linear or constant, never under ``least``."""
    x = step.cast("double")
    progress = (x - warmup) / max(1, total - warmup)
    after = {"linear": 1.0 - progress, "constant": F.lit(1.0), "cosine": (F.cos(F.least(F.lit(1.0), progress) * math.pi) + 1.0) * 0.5}[kind]
    return F.when(x < warmup, F.greatest(F.lit(1e-8), x / max(1, warmup))).otherwise(F.greatest(F.lit(least), after))


def curriculum(step: Column, phases: tuple = PHASES) -> Column:
    """The phase of a step and its difficulty shares."""
    shares = lambda k, c, m, h: F.struct(F.lit(k).alias("phase"), F.lit(c).alias("clean"), F.lit(m).alias("mild"), F.lit(h).alias("hard"))
    out = shares(len(phases), *phases[-1][1:])
    for k in range(len(phases) - 2, -1, -1):
        out = F.when(step < phases[k][0], shares(k + 1, *phases[k][1:])).otherwise(out)
    return out


def steps_per_epoch(samples: Column, micro: int, accumulate: int = 1, world: int = 1) -> Column:
    return F.ceil(samples / (micro * accumulate * world))


def recycled(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first rows again and again until there are ``n``; a benchmark's input. An empty table stays empty."""
    have = df.count()
    if not have:
        return df
    rounds = df.sparkSession.range(math.ceil(n / have)).withColumnRenamed("id", "round")
    return df.crossJoin(F.broadcast(rounds)).orderBy("round", order).limit(n).drop("round")  # rounds: one row each
