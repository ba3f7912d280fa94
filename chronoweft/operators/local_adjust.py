"""Optional local shifts: large residuals are corrected at the nearest silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import event_confidence, half_even
from .joins import nearest_interval

THRESHOLD_MS, SEARCH_SECONDS = 80.0, 0.4


def events(matches: DataFrame, silence: DataFrame, threshold_ms: float = THRESHOLD_MS, search_seconds: float = SEARCH_SECONDS, track: str = "track") -> tuple[DataFrame, DataFrame]:
    """(events, warnings).  Events: (track, match_id, split_time, shift_seconds, residual_ms, confidence),
    in order of ``match_id``; warnings: (track, match_id, message) where no silence is near.

    Silence regions (start, end) are those of the series before any shift; the
    place asked for is the match's local start, the shift its negative residual.
    """
    large = matches.where(F.col("included_in_regression") & (F.abs("residual_ms") >= threshold_ms)).select(track, "match_id", "local_start", "residual_ms")
    near = nearest_interval(large, silence, "local_start", search_seconds, [track, "match_id"], track)
    found = near.where("nearest IS NOT NULL").select(
        track, "match_id", F.col("nearest").alias("split_time"), (-F.col("residual_ms") / 1000.0).alias("shift_seconds"), "residual_ms", event_confidence("residual_ms").alias("confidence")
    )
    text = F.format_string("no safe silence near %.3fs for residual %.1fms; skipped", "local_start", "residual_ms")
    return found, near.where("nearest IS NULL").select(track, "match_id", text.alias("message"))


def shifted(samples: DataFrame, found: DataFrame, rate: float, track: str = "track") -> DataFrame:
    """Samples (idx, v) after all shifts, one after another, lengths kept and holes silent.

    A shift moves what lies at or behind its split.  Where each old sample ends
    up is a fold over the track's shifts; samples pushed over the end or pulled
    over a split are lost.
    """
    cut, move = half_even(F.col("split_time") * F.lit(float(rate))), half_even(F.col("shift_seconds") * F.lit(float(rate)))
    lists = found.groupBy(track).agg(F.array_sort(F.collect_list(F.struct(F.col("match_id"), cut.alias("c"), move.alias("m")))).alias("shifts"))
    lengths = samples.groupBy(track).agg((F.max("idx") + 1).alias("n"))
    rows = samples.join(lengths.join(lists, track, "left"), track)
    gone = F.lit(-1).cast("long")

    def step(at, s):
        back = at + s["m"]
        late = F.when(back >= F.col("n"), gone).otherwise(back)
        early = F.when(back < s["c"], gone).otherwise(back)
        return F.when((at < s["c"]) | (s["c"] >= F.col("n")) | (at < 0), at).otherwise(F.when(s["m"] >= 0, late).otherwise(early))

    at = F.when(F.col("shifts").isNull(), F.col("idx")).otherwise(F.aggregate("shifts", F.col("idx").cast("long"), step))
    moved = rows.select(track, at.alias("idx"), "v").where("idx >= 0")
    return samples.select(track, "idx").join(moved, [track, "idx"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
