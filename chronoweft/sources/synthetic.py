"""Generated recordings: a program of tones, and the same heard through a known time map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import half_even

#: Fixed values of the program: tone and pause in seconds, and the tones' frequencies in turn.
TONE, PAUSE = 1.2, 0.4
FREQUENCIES = (220.0, 330.0, 247.0, 392.0, 294.0, 440.0)


def program(spark: SparkSession, rate: int = 8000, seconds: float = 24.0) -> DataFrame:
    """(idx, v): tones of changing pitch under a half-sine envelope, with a deterministic hiss."""
    n = int(round(rate * seconds))
    t = F.col("idx") / F.lit(float(rate))
    no, within = F.floor(t / F.lit(TONE + PAUSE)).cast("int"), t - F.floor(t / F.lit(TONE + PAUSE)) * F.lit(TONE + PAUSE)
    pitch = F.element_at(F.array(*(F.lit(f) for f in FREQUENCIES)), (no % len(FREQUENCIES) + 1))
    hiss = F.pmod(F.xxhash64("idx"), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0
    tone = F.sin(F.lit(2 * math.pi) * (pitch * within + 35.0 * within * within)) * 0.35 + hiss * 0.65
    whole = (no + 1) * F.lit(TONE + PAUSE) <= F.lit(seconds)
    loud = F.when((within < TONE) & whole, F.sin(F.lit(math.pi) * within / TONE) * 0.18).otherwise(0.0)
    return spark.range(n).select(F.col("id").alias("idx"), (loud * tone).alias("v"))


def constant(t: Column, offset: float = 0.75, stretch: float = 1.0) -> Column:
    return F.lit(offset) + F.lit(stretch) * t


def bent(t: Column, offset: float = 1.0, at: float = 12.0, rate: float = 1.003) -> Column:
    """Rate one up to ``at``, ``rate`` after it."""
    return F.lit(offset) + F.when(t <= at, t).otherwise(F.lit(at) + (t - at) * rate)


def swaying(t: Column, offset: float = 1.0, depth: float = 0.035, period: float = 24.0) -> Column:
    return F.lit(offset) + t + F.lit(depth) * F.sin(F.lit(2 * math.pi / period) * t)


#: The calibration cases: name -> (map, local seconds left out).
CASES = {
    "known-offset": (lambda t: constant(t, 0.75, 1.0), None),
    "constant-drift": (lambda t: constant(t, 0.75, 1.0008), None),
    "piecewise-drift": (bent, None),
    "smooth-spline-drift": (swaying, None),
    "dropout-like-gap": (lambda t: constant(t, 0.75, 1.0), (10.0, 13.0)),
}


def heard(local: DataFrame, mapping, rate: int, master_seconds: float, dropout: tuple[float, float] | None = None) -> DataFrame:
    """(idx, v) on the reference: samples land on the nearest place of the map, those that share one add up."""
    t = F.col("idx") / F.lit(float(rate))
    rows = local if dropout is None else local.where(~t.between(*dropout))
    landed = rows.select(half_even(mapping(t) * F.lit(float(rate))).alias("idx"), "v").groupBy("idx").agg(F.sum("v").alias("v"))
    n = int(round(master_seconds * rate))
    grid = local.sparkSession.range(n).select(F.col("id").alias("idx"))
    v = F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.coalesce("v", F.lit(0.0))))
    return grid.join(landed, "idx", "left").select("idx", v.alias("v"))
