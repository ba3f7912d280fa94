"""Sequences: frames, runs, interval algebra, gaps, decimation.

Every function takes and gives DataFrames keyed by a ``track`` column; windows
are always partitioned by it, frames need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, track: str, order: list, name: str = "idx") -> DataFrame:
    """``rows`` with their number in the track, from 0."""
    w = Window.partitionBy(track).orderBy(*order)
    return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def frame_energy(samples: DataFrame, frame: int, hop: int, track: str = "track", floor: float = 1e-12) -> DataFrame:
    """(track, frame, start, energy) of the overlapping, complete frames of a series (track, idx, v).

    Each sample joins the frames that hold it, and a frame is complete when it
    counts ``frame`` samples: sums combine before they shuffle, and no window has
    to hold a whole recording.
    """
    i = F.col("idx")
    first = F.greatest(F.lit(0), F.ceil((i - (frame - 1)) / F.lit(hop))).cast("long")
    last = F.floor(i / F.lit(hop)).cast("long")
    held = samples.where(first <= last).select(track, F.explode(F.sequence(first, last)).alias("frame"), "v") if frame >= hop else samples.where(i % hop < frame).select(track, last.alias("frame"), "v")
    sums = held.groupBy(track, "frame").agg(F.sum(F.col("v") * F.col("v")).alias("s"), F.count("*").alias("n"))
    return sums.where(F.col("n") == frame).select(
        track, "frame", (F.col("frame") * hop).alias("start"), F.sqrt(F.col("s") / F.lit(float(frame)) + F.lit(floor)).alias("energy")
    )


def rolling_sums(samples: DataFrame, size: int, track: str = "track") -> DataFrame:
    """``samples`` with the sums of v and v*v over the ``size`` samples from each on (null where fewer are left)."""
    w = Window.partitionBy(track).orderBy("idx").rowsBetween(0, size - 1)
    whole = F.count("*").over(w) == size
    v = F.col("v")
    return samples.withColumn("sum_v", F.when(whole, F.sum(v).over(w))).withColumn("sum_vv", F.when(whole, F.sum(v * v).over(w)))


def runs(flagged: DataFrame, flag: Column, position: str, track: str = "track") -> DataFrame:
    """The flagged rows with ``run``: rows at consecutive positions share one."""
    w = Window.partitionBy(track).orderBy(position)
    return flagged.where(flag).withColumn("run", F.col(position) - F.row_number().over(w))


def merged(intervals: DataFrame, track: str = "track", start: str = "start", end: str = "end") -> DataFrame:
    """The union of each track's intervals; those that touch are one."""
    w = Window.partitionBy(track).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    grouped = intervals.select(track, start, end).withColumn("opens", opens)
    grouped = grouped.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(track, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def complement(intervals: DataFrame, extents: DataFrame, track: str = "track", start: str = "start", end: str = "end") -> DataFrame:
    """What the intervals leave free of 0 to each track's ``total`` (``extents``: track, total)."""
    w = Window.partitionBy(track).orderBy(start, end)
    cursor = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = intervals.select(track, F.greatest(cursor, F.lit(0.0)).alias("free_start"), F.col(start).alias("free_end"))
    reach = intervals.groupBy(track).agg(F.max(end).alias("reach"))
    tail = extents.join(reach, track, "left").select(track, F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(0.0)).alias("free_start"), F.col("total").alias("free_end"))
    return before.unionByName(tail).where("free_start < free_end").select(track, F.col("free_start").alias(start), F.col("free_end").alias(end))


def steps(rows: DataFrame, value: str, order: str, track: str = "track") -> DataFrame:
    """``rows`` with ``step``: the next value less this one (null at the end)."""
    w = Window.partitionBy(track).orderBy(order)
    return rows.withColumn("step", F.lead(value).over(w) - F.col(value))


def monotonicity(rows: DataFrame, value: str, order: str, epsilon: float, track: str = "track") -> DataFrame:
    """(track, n, min_step, median_step, rising): whether a sampled map rises by more than ``epsilon`` everywhere."""
    return (
        steps(rows, value, order, track)
        .groupBy(track)
        .agg(F.count("*").alias("n"), F.min("step").alias("min_step"), F.median("step").alias("median_step"), F.coalesce(F.bool_and(F.col("step") > epsilon), F.lit(True)).alias("rising"))
    )


def anchor_gaps(matches: DataFrame, threshold: float | None, track: str = "track") -> DataFrame:
    """Stretches between neighbouring anchors that are long locally or on the reference, and positive on both."""
    w = Window.partitionBy(track).orderBy("local_start", "match_id")
    out = matches.select(
        track,
        F.lag("local_end").over(w).alias("local_start"),
        F.col("local_start").alias("local_end"),
        F.lag("master_end").over(w).alias("master_start"),
        F.col("master_start").alias("master_end"),
    )
    out = out.withColumn("local_gap_seconds", F.col("local_end") - F.col("local_start")).withColumn("master_gap_seconds", F.col("master_end") - F.col("master_start"))
    if threshold is None:
        return out.where(F.lit(False))
    both = (F.col("local_gap_seconds") > 0) & (F.col("master_gap_seconds") > 0)
    return out.where(both & ((F.col("local_gap_seconds") > threshold) | (F.col("master_gap_seconds") > threshold)))


def spans(points: DataFrame, extents: DataFrame, point: str = "midpoint", track: str = "track") -> DataFrame:
    """(track, left, gap) between neighbouring points, from 0 to the first and from the last to the track's ``total``."""
    ends = extents.select(track, F.col("total").alias(point))
    w = Window.partitionBy(track).orderBy(point, "kind")
    every = points.select(track, point, F.lit(0).alias("kind")).unionByName(ends.withColumn("kind", F.lit(1)))
    left = F.coalesce(F.lag(point).over(w), F.lit(0.0))
    return every.select(track, left.alias("left"), F.greatest(F.lit(0.0), F.col(point) - left).alias("gap"))


def decimated(rows: DataFrame, time: str, value: str, spacing: float, track: str = "track") -> DataFrame:
    """(track, knots): the points of each track thinned from left to right to ``spacing`` at least, the last always kept.

    A point depends on which one was kept before it, so this folds over each
    track's sorted points inside one expression.
    """
    point = F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    points = rows.groupBy(track).agg(F.array_sort(F.collect_list(point)).alias("points"))
    none = F.array().cast("array<struct<t:double,y:double>>")
    kept = F.aggregate(
        "points",
        none,
        lambda acc, p: F.when((F.size(acc) > 0) & (p["t"] - F.element_at(acc, -1)["t"] < spacing), acc).otherwise(F.concat(acc, F.array(p))),
    )
    out = points.withColumn("kept", kept).withColumn("last", F.element_at("points", -1))
    tail = F.element_at("kept", -1)
    short = F.col("last.t") - tail["t"] < spacing
    ended = (
        F.when(F.col("last.t") <= tail["t"], F.col("kept"))
        .when(short & (F.size("kept") > 1), F.concat(F.slice("kept", 1, F.size("kept") - 1), F.array("last")))
        .otherwise(F.concat("kept", F.array("last")))
    )
    return out.select(track, ended.alias("knots"))
