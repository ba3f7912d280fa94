"""Linear time maps: weighted fits with outlier rejection, their diagnostics and residuals.

Matches are rows (track, match_id, local_start, local_end, master_start,
master_end, confidence, rejected_reason); every fit gives a new version of them.
The whole fit is aggregates and joins by track.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.signal import kalman_filter, kalman_smoother
from .series import anchor_gaps

#: The least threshold in ms, its multiples of the residuals' spread and middle, rounds, least weight.
LEAST_MS, MADS, MEDIANS, REJECTION_ROUNDS, LEAST_WEIGHT = 40.0, 3.5, 2.5, 2, 1e-3
#: Reasons that a fit gives, and a new fit takes back.
FIT_REASONS = ("excluded_by_min_confidence", "confidence_below_min_for_fit", "residual_outlier", "outside_spline_support", "outside_piecewise_support")


def weighted_line(rows: DataFrame, x: str, y: str, w: str, track: str = "track") -> DataFrame:
    """(track, n, slope, intercept): the weighted least-squares line of each track.

    Sums are taken around each track's mean.  Where all x are equal the line of
    least norm through the mean is taken, as a pseudo-inverse would.
    """
    mean = rows.groupBy(track).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mx"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("my"))
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    sums = rows.join(mean, track).groupBy(track, "mx", "my").agg(F.count("*").alias("n"), F.sum(F.col(w) * dx * dx).alias("sxx"), F.sum(F.col(w) * dx * dy).alias("sxy"), F.max(F.abs(dx)).alias("reach"))
    flat = F.col("reach") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("mx"))
    least = F.col("mx") * F.col("my") / (F.col("mx") * F.col("mx") + 1.0)
    slope = F.when(flat, least).otherwise(F.col("sxy") / F.when(~flat, F.col("sxx")))
    return sums.select(track, "n", slope.alias("slope"), "mx", "my").select(track, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def residual_ms(slope: str = "slope", intercept: str = "intercept") -> Column:
    return (F.col("master_start") - (F.col(slope) * F.col("local_start") + F.col(intercept))) * 1000.0


def reset(matches: DataFrame) -> DataFrame:
    """Matches without the reasons that an earlier fit gave."""
    if "rejected_reason" not in matches.columns:
        return matches.withColumn("rejected_reason", F.lit(None).cast("string"))
    return matches.withColumn("rejected_reason", F.when(~F.coalesce(F.col("rejected_reason").isin(*FIT_REASONS), F.lit(False)), F.col("rejected_reason")))


def _line_over(rows: DataFrame, keep: str, over) -> DataFrame:
    """``rows`` with ``slope`` and ``intercept`` of the kept rows' weighted line, by windows alone."""
    w, x, y = (F.when(F.col(keep), F.col(c)) for c in ("w", "local_start", "master_start"))
    total = F.sum(w).over(over)
    out = rows.withColumn("mx", F.sum(w * x).over(over) / total).withColumn("my", F.sum(w * y).over(over) / total)
    dx, dy = x - F.col("mx"), y - F.col("my")
    out = out.withColumn("sxx", F.sum(w * dx * dx).over(over)).withColumn("sxy", F.sum(w * dx * dy).over(over)).withColumn("reach", F.max(F.abs(dx)).over(over))
    flat = F.col("reach") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("mx"))
    slope = F.when(flat, F.col("mx") * F.col("my") / (F.col("mx") * F.col("mx") + 1.0)).otherwise(F.col("sxy") / F.when(~flat, F.col("sxx")))
    out = out.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    return out.drop("mx", "my", "sxx", "sxy", "reach")


def fit_linear(matches: DataFrame, min_confidence: float = 0.05, track: str = "track") -> tuple[DataFrame, DataFrame]:
    """(models, matches): each track's line after two rounds of rejection, and the matches judged by it.

    A track with fewer than two eligible matches has no model.  A round that
    would leave fewer than two, or rejects nothing, ends the rejection (the next
    one then sees the same rows and decides alike).  All of it is windows by
    track, so the matches are dealt out once.
    """
    over = Window.partitionBy(track)
    eligible = F.col("rejected_reason").isNull() & (F.col("confidence") >= min_confidence)
    rows = reset(matches).withColumn("keep", eligible).withColumn("w", F.greatest(F.col("confidence"), F.lit(LEAST_WEIGHT)))
    rows = rows.withColumn("eligible_count", F.count_if("keep").over(over)).withColumn("keep", F.col("keep") & (F.col("eligible_count") >= 2))
    for _ in range(REJECTION_ROUNDS):
        rows = _line_over(rows, "keep", over).withColumn("r", residual_ms())
        r = F.when(F.col("keep"), F.col("r"))
        rows = rows.withColumn("mid", F.median(r).over(over)).withColumn("size", F.median(F.abs(r)).over(over))
        rows = rows.withColumn("mad", F.median(F.abs(r - F.col("mid"))).over(over))
        rows = rows.withColumn("threshold_ms", F.greatest(F.lit(LEAST_MS), F.col("mad") * MADS, F.col("size") * MEDIANS))
        fits = F.col("keep") & (F.abs("r") <= F.col("threshold_ms"))
        rows = rows.withColumn("left", F.count_if(fits).over(over)).withColumn("keep", F.when(F.col("left") < 2, F.col("keep")).otherwise(fits))
        rows = rows.drop("r", "mid", "size", "mad", "left", "slope", "intercept")
    rows = _line_over(rows, "keep", over)
    has = F.col("eligible_count") >= 2
    reason = F.coalesce(
        F.col("rejected_reason"),
        F.when(F.col("confidence") < min_confidence, "excluded_by_min_confidence").when(has & ~F.col("keep"), "residual_outlier"),
    )
    rows = rows.withColumn("residual_ms", F.when(has, residual_ms())).withColumn("rejected_reason", reason)
    r = F.when(F.col("keep"), F.abs("residual_ms"))
    models = rows.where(has).groupBy(track).agg(
        F.first("slope").alias("stretch_ratio"), F.first("intercept").alias("offset_seconds"), F.count_if("keep").alias("anchor_count"), F.first("eligible_count").alias("eligible_count"),
        F.median(r).alias("residual_median_ms"), F.max(r).alias("residual_max_ms"), F.first("threshold_ms").alias("threshold_ms"),
    )
    judged = rows.withColumnRenamed("keep", "included_in_regression").drop("w", "eligible_count", "threshold_ms", "slope", "intercept")
    return models, judged


def diagnostics(models: DataFrame, judged: DataFrame, durations: DataFrame | None = None, track: str = "track") -> DataFrame:
    """One row for each model: counts, the span that its anchors cover, and the share of the track's ``total``."""
    span = judged.where("included_in_regression").groupBy(track).agg(F.min("local_start").alias("span_start"), F.max("local_start").alias("span_end"), F.count("*").alias("fitted"))
    total = judged.groupBy(track).agg(F.count("*").alias("input_anchor_count"))
    out = models.select(track, "eligible_count", "threshold_ms").join(span, track).join(total, track)
    out = out.join(durations, track, "left") if durations is not None else out.withColumn("total", F.lit(None).cast("double"))
    seconds = F.greatest(F.lit(0.0), F.col("span_end") - F.col("span_start"))
    ratio = F.when(F.col("total") > 0, seconds / F.col("total"))
    return out.select(
        track, "input_anchor_count", F.col("fitted").alias("fitted_anchor_count"), (F.col("eligible_count") - F.col("fitted")).alias("outlier_count"),
        "span_start", "span_end", seconds.alias("span_seconds"), ratio.alias("span_ratio"), "threshold_ms", "total",
    )


def fit_warnings(diag: DataFrame, gaps: DataFrame, track: str = "track") -> DataFrame:
    """(track, seq, code, time_seconds): rejected outliers, long gaps between anchors, weak spans."""
    long = (F.col("total") >= 120.0)
    weak = F.when(long & (F.col("span_ratio") < 0.25), "VERY_WEAK_DRIFT_ANCHOR_SPAN").when(long & (F.col("span_ratio") < 0.5) & (F.col("fitted_anchor_count") >= 3), "WEAK_DRIFT_ANCHOR_SPAN")
    none = F.lit(None).cast("double")
    outliers = diag.where("outlier_count > 0").select(track, F.lit(0).alias("seq"), F.lit("DRIFT_OUTLIERS_REJECTED").alias("code"), none.alias("time_seconds"))
    dropouts = gaps.select(track, F.lit(1).alias("seq"), F.lit("ANCHOR_GAP_UNSUPPORTED_REGION").alias("code"), F.col("master_start").alias("time_seconds"))
    spans = diag.withColumn("code", weak).where("code IS NOT NULL").select(track, F.lit(2).alias("seq"), "code", F.col("span_start").alias("time_seconds"))
    return outliers.unionByName(dropouts).unionByName(spans)


def unsupported(judged: DataFrame, max_gap: float | None, track: str = "track") -> DataFrame:
    """Gaps between the included anchors that are longer than ``max_gap``."""
    return anchor_gaps(judged.where("included_in_regression"), max_gap, track)


def summary(judged: DataFrame, track: str = "track") -> DataFrame:
    """(track, matches, included, rejected, residual min, median and max of the included)."""
    r = F.when(F.col("included_in_regression"), F.col("residual_ms"))
    return judged.groupBy(track).agg(
        F.count("*").alias("match_count"), F.count_if("included_in_regression").alias("included_count"), F.count_if(~F.col("included_in_regression")).alias("rejected_count"),
        F.min(r).alias("residual_min_ms"), F.median(r).alias("residual_median_ms"), F.max(r).alias("residual_max_ms"),
    )


def hinge(x: Column, intercept: Column, slope: Column, breaks: Column, changes: Column) -> Column:
    """A continuous piecewise line: changes of slope at the breaks (arrays)."""
    return F.aggregate(F.arrays_zip(breaks.alias("b"), changes.alias("c")), intercept + slope * x, lambda a, p: a + p["c"] * F.greatest(F.lit(0.0), x - p["b"]))


def segment_rates(slope: Column, changes: Column) -> Column:
    """The slope of every segment, first to last."""
    return F.aggregate(changes, F.array(slope), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)))


_FILTERED = ("offset", "rate", "p00", "p01", "p11", "po", "pr", "q00", "q01", "q11")


def _by_track(rows: DataFrame, track: str, run, out: tuple[str, ...]) -> DataFrame:
    """``run`` over each track's sorted Arrow table; gives (track, n, t, out)."""
    schema = T.StructType([rows.schema[track], T.StructField("n", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("t", *out))])
    arrow = to_arrow_schema(schema)

    def each(table: pa.Table) -> pa.Table:
        t, made = run(table)
        columns = [table[track].combine_chunks(), pa.array(np.arange(len(t)), pa.int32()), pa.array(t, pa.float64()), *(pa.array(made[:, i]) for i in range(made.shape[1]))]
        return pa.Table.from_arrays(columns, schema=arrow)

    return rows.groupBy(track).applyInArrow(each, schema)


def kalman_forward(rows: DataFrame, offset_sigma: float, rate_sigma: float, observation_sigma: float, offset_prior: float, rate_prior: float, track: str = "track") -> DataFrame:
    """Filtered states of each track, in order of time; linear in a track's length.

    ``rows``: (track, t, z, confidence, first_offset, first_rate), the state before
    the first observation; states are [offset, rate] with a symmetric covariance
    (p00, p01, p11).  Gives (track, n, t, offset, rate, p00, p01, p11) and the
    prediction (po, pr, q00, q01, q11).
    """
    sorted_by = [("t", "ascending"), ("z", "ascending"), ("confidence", "ascending")]

    def run(table: pa.Table):
        at = pc.sort_indices(table, sorted_by)
        t, z, c, o, r = (table[n].take(at).to_numpy() for n in ("t", "z", "confidence", "first_offset", "first_rate"))
        noise = (observation_sigma / np.maximum(c, LEAST_WEIGHT)) ** 2
        return t, kalman_filter(t, z, noise, (float(o[0]), float(r[0])), (offset_prior**2, rate_prior**2), offset_sigma**2, rate_sigma**2)

    d = [F.col(c).cast("double").alias(c) for c in ("t", "z", "confidence", "first_offset", "first_rate")]
    return _by_track(rows.select(track, *d), track, run, _FILTERED)


def rts_smooth(filtered: DataFrame, track: str = "track") -> DataFrame:
    """Smoothed states (track, n, t, offset, rate, p00, p01, p11) from filtered ones, from the end."""

    def run(table: pa.Table):
        at = pc.sort_indices(table, [("n", "ascending")])
        t = table["t"].take(at).to_numpy()
        return t, kalman_smoother(t, np.column_stack([table[c].take(at).to_numpy() for c in _FILTERED]))

    return _by_track(filtered.select(track, "n", "t", *_FILTERED), track, run, _FILTERED[:5])


def uncertainty_band(states: DataFrame, sigmas: float = 1.0) -> DataFrame:
    """States with (master_t, low, high): the reference time that a state gives its local one, and ``sigmas`` deviations on either side."""
    sd = F.sqrt(F.greatest("p00", F.lit(0.0))) * sigmas
    master = F.col("t") + F.col("offset")
    return states.withColumn("master_t", master).withColumn("low", master - sd).withColumn("high", master + sd)


def segment_residuals(judged: DataFrame, breaks: DataFrame, track: str = "track") -> DataFrame:
    """(track, segment, n, residual_median_ms, residual_max_ms) of the included matches of every segment, empty ones too.

    ``breaks`` has each track's ascending ``breaks``; a break's own match belongs
    to the segment after it, and the last segment has all to its end.
    """
    rows = judged.where("included_in_regression").select(track, "local_start", "residual_ms").join(breaks.select(track, "breaks"), track)
    own = F.size(F.filter("breaks", lambda b: b <= F.col("local_start")))
    r = F.abs("residual_ms")
    found = rows.select(track, own.alias("segment"), "residual_ms").groupBy(track, "segment").agg(F.count("*").alias("n"), F.median(r).alias("residual_median_ms"), F.max(r).alias("residual_max_ms"))
    every = breaks.select(track, F.explode(F.sequence(F.lit(0), F.size("breaks"))).alias("segment"))
    zero = {"n": F.lit(0).cast("long"), "residual_median_ms": F.lit(0.0), "residual_max_ms": F.lit(0.0)}
    return every.join(found, [track, "segment"], "left").select(track, "segment", *(F.coalesce(c, z).alias(c) for c, z in zero.items()))


def rate_figures(rates: DataFrame, order: str = "segment", track: str = "track") -> DataFrame:
    """(track, rate_min, rate_max, rate_mean, max_abs_rate_deviation_ppm, max_rate_change_ppm) of each track's local ``rate`` rows."""
    w = Window.partitionBy(track).orderBy(order)
    turned = rates.withColumn("turn", F.abs(F.col("rate") - F.lag("rate").over(w)))
    return turned.groupBy(track).agg(
        F.min("rate").alias("rate_min"), F.max("rate").alias("rate_max"), F.avg("rate").alias("rate_mean"),
        (F.max(F.abs(F.col("rate") - 1.0)) * 1e6).alias("max_abs_rate_deviation_ppm"), (F.coalesce(F.max("turn"), F.lit(0.0)) * 1e6).alias("max_rate_change_ppm"),
    )
