"""Joins on time: ranges, overlaps, nearest intervals, as-of lookup and interpolation.

A join on a range alone would be a nested loop over all pairs.  Here both sides
get a time bucket as an equality key, so Catalyst plans a hash or sort-merge
join, and the exact predicate is checked within the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def point_in_range(points: DataFrame, ranges: DataFrame, time: str, start: str, end: str, width: float, track: str = "track", how: str = "inner", closed: bool = True) -> DataFrame:
    """Points joined with the ranges of their track that hold them (``closed`` at the end or not).

    ``ranges`` is spread over the buckets it touches; a point has one bucket, so
    no pair is found twice.
    """
    p = points.withColumn("__b", _bucket(F.col(time), width))
    spread = F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width)))
    r = ranges.where(F.col(start) <= F.col(end)).withColumnRenamed(track, "__track").withColumn("__rb", spread)
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    on = (F.col(track) == F.col("__track")) & (F.col("__b") == F.col("__rb")) & inside
    return p.join(r, on, how).drop("__b", "__rb", "__track")


def overlapping(left: DataFrame, right: DataFrame, width: float, track: str = "track", left_start: str = "l_start", left_end: str = "l_end", right_start: str = "r_start", right_end: str = "r_end") -> DataFrame:
    """Pairs of intervals of one track that overlap by more than a point.

    Both sides are spread over buckets; a pair is kept in the first bucket that
    both touch.
    """
    a = left.withColumn("__b", F.explode(F.sequence(_bucket(F.col(left_start), width), _bucket(F.col(left_end), width))))
    b = right.withColumnRenamed(track, "__track").withColumn("__rb", F.explode(F.sequence(_bucket(F.col(right_start), width), _bucket(F.col(right_end), width))))
    first = _bucket(F.greatest(F.col(left_start), F.col(right_start)), width)
    on = (F.col(track) == F.col("__track")) & (F.col("__b") == F.col("__rb"))
    meets = (F.col(left_start) < F.col(right_end)) & (F.col(right_start) < F.col(left_end)) & (F.col("__b") == first)
    return a.join(b, on).where(meets).drop("__b", "__rb", "__track")


def overlap_ratio(queries: DataFrame, active: DataFrame, width: float, key: list[str], track: str = "track") -> DataFrame:
    """``queries`` (l_start, l_end) with ``overlap_ratio``: the share that merged ``active`` (r_start, r_end) covers."""
    length = F.greatest(F.lit(0.0), F.col("l_end") - F.col("l_start"))
    pairs = overlapping(queries, active, width, track)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    sums = pairs.groupBy(*key).agg(F.sum(shared).alias("shared"))
    ratio = F.when(length > 0, F.least(F.lit(1.0), F.coalesce("shared", F.lit(0.0)) / length)).otherwise(0.0)
    return queries.join(sums, key, "left").withColumn("overlap_ratio", ratio).drop("shared")


def nearest_interval(points: DataFrame, intervals: DataFrame, time: str, tolerance: float, key: list[str], track: str = "track", start: str = "start", end: str = "end") -> DataFrame:
    """``points`` with ``nearest``: the closest time inside an interval, at most ``tolerance`` away; the earliest interval on a tie."""
    reach = intervals.select(F.col(track), F.col(start).alias("i_start"), F.col(end).alias("i_end"), (F.col(start) - tolerance).alias("i_from"), (F.col(end) + tolerance).alias("i_to"))
    pairs = point_in_range(points, reach, time, "i_from", "i_to", max(tolerance, 1e-3) * 8, track)
    place = F.least(F.greatest(F.col(time), F.col("i_start")), F.col("i_end"))
    best = F.min(F.struct(F.abs(place - F.col(time)).alias("d"), F.col("i_start").alias("s"), place.alias("at")))
    found = pairs.groupBy(*key).agg(best.alias("best")).select(*key, F.col("best.at").alias("nearest"))
    return points.join(found, key, "left")


def pieces(knots: DataFrame, x: str, values: list[str], track: str = "track") -> DataFrame:
    """Neighbouring knots as rows: ``x0``, ``x1``, and ``<v>0``, ``<v>1`` for each value; ``no`` counts from 0."""
    w = Window.partitionBy(track).orderBy(x)
    out = knots.select(
        track,
        (F.row_number().over(w) - 1).alias("no"),
        F.col(x).alias("x0"),
        F.lead(x).over(w).alias("x1"),
        *(c for v in values for c in (F.col(v).alias(f"{v}0"), F.lead(v).over(w).alias(f"{v}1"))),
    )
    return out.where(F.col("x1").isNotNull())


def lookup_piece(points: DataFrame, parts: DataFrame, time: str, track: str = "track") -> DataFrame:
    """Points with the piece they lie in; before the first and after the last piece with that one.

    An as-of join: the pieces' starts and the points are merged in order of time
    and each point takes the last start at or before it, so the cost is one sort
    by track and no pair is formed.  A point on a border gets the piece that
    starts there.
    """
    fields = [c for c in parts.columns if c != track]
    piece = F.struct(*fields)
    w = Window.partitionBy(track).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    point = F.struct(*[c for c in points.columns if c != track])
    first = parts.groupBy(track).agg(F.min_by(piece, "x0").alias("__first"))
    a = parts.select(F.col(track), F.col("x0").alias("__t"), F.lit(0).alias("__kind"), piece.alias("__piece"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("__point"))
    b = points.select(F.col(track), F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(parts.select(piece.alias("p")).schema["p"].dataType).alias("__piece"), point.alias("__point"))
    both = a.unionByName(b).withColumn("__at", F.last("__piece", ignorenulls=True).over(w)).where("__kind = 1")
    out = both.join(first, track, "left").withColumn("__at", F.coalesce("__at", "__first"))
    return out.select(track, "__point.*", *(F.col(f"__at.{c}").alias(c) for c in fields))


def interpolated(points: DataFrame, knots: DataFrame, time: str, x: str, y: str, track: str = "track", extrapolate: bool = False, out: str = "value") -> DataFrame:
    """Linear interpolation of (x, y) knots at the points; outside null, or along the end pieces."""
    found = lookup_piece(points, pieces(knots, x, [y], track), time, track)
    t = F.col(time)
    share = (t - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = F.when(t == F.col("x1"), F.col(f"{y}1")).otherwise(F.col(f"{y}0") + share * (F.col(f"{y}1") - F.col(f"{y}0")))
    if not extrapolate:
        value = F.when((t >= F.col("x0")) & (t <= F.col("x1")), value)
    return found.withColumn(out, value).drop("no", "x0", "x1", f"{y}0", f"{y}1")


def slope_at(points: DataFrame, knots: DataFrame, time: str, x: str, y: str, track: str = "track") -> DataFrame:
    """Points with ``rate``: one plus the slope of the piece that starts at or before each."""
    found = lookup_piece(points, pieces(knots, x, [y], track), time, track)
    rate = F.lit(1.0) + (F.col(f"{y}1") - F.col(f"{y}0")) / (F.col("x1") - F.col("x0"))
    return found.withColumn("rate", rate).drop("no", "x0", "x1", f"{y}0", f"{y}1")


def segment_of(points: DataFrame, segments: DataFrame, time: str, key: list[str], track: str = "track") -> DataFrame:
    """Points with the first segment (seg_start, seg_end, both inclusive) that holds them; the
    first for points at or before its start, else the last."""
    others = [c for c in segments.columns if c != track]
    one = F.struct(F.col("seg_start"), *[c for c in others if c != "seg_start"])
    ends = segments.groupBy(F.col(track).alias("__t2")).agg(F.min(one).alias("__first"), F.max(one).alias("__last"))
    span = segments.agg(F.avg(F.col("seg_end") - F.col("seg_start"))).first()[0] or 1.0
    inside = point_in_range(points, segments, time, "seg_start", "seg_end", max(span, 1e-6), track)
    hit = inside.groupBy(*key).agg(F.min(one).alias("__hit"))
    found = points.join(hit, key, "left").join(ends, F.col(track) == F.col("__t2"), "left")
    pick = F.when(F.col(time) <= F.col("__first.seg_start"), F.col("__first")).otherwise(F.coalesce("__hit", "__last"))
    return found.withColumn("__pick", pick).select(*points.columns, *(F.col(f"__pick.{c}").alias(c) for c in others))


def knot_cells(points: DataFrame, knots: DataFrame, time: str, x: str, track: str = "track") -> DataFrame:
    """Points with ``knot``: the knot whose cell, from midpoint to midpoint, half open, holds each."""
    w = Window.partitionBy(track).orderBy(x)
    left = (F.lag(x).over(w) + F.col(x)) / 2.0
    cells = knots.select(track, F.coalesce(left, F.lit(float("-inf"))).alias("x0"), F.col(x).alias("knot"))
    return lookup_piece(points, cells, time, track).drop("x0")


def outside_gaps(points: DataFrame, gaps: DataFrame, time: str, value: str, width: float, key: list[str], track: str = "track") -> DataFrame:
    """Points whose ``value`` is null where ``time`` lies strictly inside a gap (gap_start, gap_end)."""
    hit = point_in_range(points, gaps, time, "gap_start", "gap_end", width, track).where((F.col(time) > F.col("gap_start")) & (F.col(time) < F.col("gap_end")))
    hit = hit.select(*key).distinct().withColumn("__in", F.lit(True))
    return points.join(hit, key, "left").withColumn(value, F.when(F.col("__in").isNull(), F.col(value))).drop("__in")


def pchip_knots(knots: DataFrame, x: str, y: str, track: str = "track") -> DataFrame:
    """Knots with ``m``: the slopes of the monotone cubic through them (Fritsch and Butland, 1984).

    A track needs two knots; with two the cubic is their line.
    """
    w = Window.partitionBy(track).orderBy(x)
    rows = knots.select(track, x, y)
    at = lambda c, n: F.lead(c, n).over(w) if n > 0 else (F.lag(c, -n).over(w) if n < 0 else F.col(c))
    rows = rows.withColumns({f"x{n + 2}": at(x, n) for n in (-2, -1, 0, 1, 2)} | {f"y{n + 2}": at(y, n) for n in (-2, -1, 0, 1, 2)})
    h = [F.col(f"x{i + 1}") - F.col(f"x{i}") for i in range(4)]
    d = [(F.col(f"y{i + 1}") - F.col(f"y{i}")) / h[i] for i in range(4)]
    w1, w2 = 2 * h[2] + h[1], h[2] + 2 * h[1]
    inner = F.when(d[1] * d[2] <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.when(d[1] != 0, d[1]) + w2 / F.when(d[2] != 0, d[2])))

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        bent = F.when(F.signum(s) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)
        return F.when(d1.isNull(), d0).otherwise(bent)

    first, last = F.col("x1").isNull(), F.col("x3").isNull()
    m = F.when(first, end(h[2], h[3], d[2], d[3])).when(last, end(h[1], h[0], d[1], d[0])).otherwise(inner)
    return rows.select(track, x, y, m.alias("m"))


def pchip_at(points: DataFrame, knots: DataFrame, time: str, x: str, y: str, track: str = "track") -> DataFrame:
    """Points with ``value`` and ``rate`` of the monotone cubic; the end cubics go on outside."""
    parts = pieces(pchip_knots(knots, x, y, track), x, [y, "m"], track)
    found = lookup_piece(points, parts, time, track)
    h = F.col("x1") - F.col("x0")
    t, d = (F.col(time) - F.col("x0")) / h, (F.col(f"{y}1") - F.col(f"{y}0")) / h
    c2, c3 = 3 * d - 2 * F.col("m0") - F.col("m1"), F.col("m0") + F.col("m1") - 2 * d
    value = F.col(f"{y}0") + h * t * (F.col("m0") + t * (c2 + t * c3))
    rate = F.col("m0") + t * (2 * c2 + 3 * t * c3)
    return found.withColumn("value", value).withColumn("rate", rate).drop("no", "x0", "x1", f"{y}0", f"{y}1", "m0", "m1")
