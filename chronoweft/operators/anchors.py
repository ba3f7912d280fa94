"""Anchors: the parts of active segments that are matched, chosen for quality and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnchorSelection
from ..functions import scalar as S
from ..functions.signal import flatness_udf
from .joins import point_in_range
from .series import spans


def local_snr(samples: DataFrame, clips: DataFrame, sample_rate: float, key: list[str], track: str = "track") -> DataFrame:
    """``clips`` (clip_start, clip_end, context_start, context_end in seconds) with ``snr_db``.

    The signal is the clip, the noise up to a second on either side of the
    context; null where there is no noise at all.  Sample positions are cut, not
    rounded; samples and windows meet in time buckets.
    """
    rate = F.lit(float(sample_rate))
    reach = F.least(F.greatest(F.col("clip_end") - F.col("clip_start"), F.lit(0.25)), F.lit(1.0))
    at = lambda x: S.truncated(x * rate)
    windows = clips.select(
        track,
        *[c for c in key if c != track],
        at(F.greatest(F.lit(0.0), F.col("clip_start"))).alias("s0"),
        at(F.col("clip_end")).alias("s1"),
        at(F.greatest(F.lit(0.0), F.col("context_start") - reach)).alias("b0"),
        at(F.col("context_start")).alias("b1"),
        at(F.col("context_end")).alias("a0"),
        at(F.col("context_end") + reach).alias("a1"),
    ).withColumn("w0", F.least("s0", "b0")).withColumn("w1", F.greatest("s1", "a1"))
    seen = point_in_range(samples, windows, "idx", "w0", "w1", float(sample_rate) * 4, track)
    i, sq = F.col("idx"), F.col("v") * F.col("v")
    signal = (i >= F.col("s0")) & (i < F.col("s1"))
    noise = ((i >= F.col("b0")) & (i < F.col("b1"))) | ((i >= F.col("a0")) & (i < F.col("a1")))
    sums = seen.groupBy(*key).agg(F.avg(F.when(signal, sq)).alias("signal"), F.avg(F.when(noise, sq)).alias("noise"))
    level = lambda c: F.greatest(S.root_mean_square(c), F.lit(1e-9))
    snr = F.when(F.col("noise").isNotNull() & F.col("signal").isNotNull(), F.lit(20.0) * F.log10(level("signal") / level("noise")))
    return clips.join(sums.select(*key, snr.alias("snr_db"), S.root_mean_square("signal").alias("rms")), key, "left")


def flatness(samples: DataFrame, clips: DataFrame, sample_rate: float, key: list[str], track: str = "track") -> DataFrame:
    """``clips`` with ``spectral_flatness``; a clip's samples, bounded by the longest anchor, make one array."""
    rate = F.lit(float(sample_rate))
    windows = clips.select(track, *[c for c in key if c != track], S.truncated(F.col("clip_start") * rate).alias("s0"), (S.truncated(F.col("clip_end") * rate) - 1).alias("s1"))
    inside = point_in_range(samples, windows, "idx", "s0", "s1", float(sample_rate) * 4, track)
    arrays = inside.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda p: p["v"].cast("double")).alias("clip"))
    return clips.join(arrays.select(*key, flatness_udf("clip").alias("spectral_flatness")), key, "left").withColumn("spectral_flatness", F.coalesce("spectral_flatness", F.lit(1.0)))


def candidates(samples: DataFrame, segments: DataFrame, totals: DataFrame, sample_rate: float, cfg: AnchorSelection, track: str = "track") -> DataFrame:
    """One row for each segment long enough, with its anchor or the reason why it has none.

    ``totals`` has each track's duration in seconds, ``total``.
    """
    long_enough = segments.where(F.col("end") - F.col("start") >= cfg.min_anchor_duration_seconds)
    clips = long_enough.withColumn("segment_id", F.xxhash64(track, "start", "end")).select(
        track, "segment_id", "start", "end", "confidence",
        F.col("start").alias("clip_start"),
        F.least("end", F.col("start") + F.least(F.lit(cfg.max_anchor_duration_seconds), F.col("end") - F.col("start"))).alias("clip_end"),
        F.col("start").alias("context_start"),
        F.col("end").alias("context_end"),
    )
    key = [track, "segment_id"]
    rated = flatness(samples, local_snr(samples, clips, sample_rate, key, track).drop("rms"), sample_rate, key, track)
    available = F.col("end") - F.col("start")
    wanted = S.requested_duration("snr_db", "spectral_flatness", cfg)
    stop = F.least(F.col("end"), F.col("start") + F.least(available, wanted))
    rated = rated.select(
        track, "segment_id", F.col("start").alias("local_start"), stop.alias("local_end"), "snr_db", "spectral_flatness",
        F.greatest(S.snr_stretch("snr_db"), S.flatness_stretch("spectral_flatness")).alias("quality_multiplier"),
        S.clamp01(F.col("confidence") * S.confidence_scale(available, "snr_db", "spectral_flatness", cfg)).alias("confidence"),
        S.anchor_rejection(available, "snr_db", "spectral_flatness", cfg).alias("rejection_reason"),
    )
    clip = rated.withColumn("clip_start", F.col("local_start")).withColumn("clip_end", F.col("local_end")).withColumn("context_start", F.col("local_start")).withColumn("context_end", F.col("local_end"))
    loud = local_snr(samples, clip.drop("snr_db"), sample_rate, key, track).select(*key, "rms")
    out = rated.join(loud, key, "left").join(totals, track).withColumn("duration_seconds", F.col("local_end") - F.col("local_start"))
    out = out.withColumn("budget", S.anchor_budget("total", cfg)).withColumn("bins", S.bin_count("total", "budget", cfg))
    return out.withColumn("bin_index", S.bin_of((F.col("local_start") + F.col("local_end")) / 2.0, "total", "bins"))


def quality_order() -> list:
    """Best first: confidence, signal to noise, low flatness, loudness, earlier start."""
    f = F.coalesce(-F.col("spectral_flatness"), F.lit(1.0))
    return [F.desc("confidence"), F.coalesce("snr_db", F.lit(0.0)).desc(), f.desc(), F.desc("rms"), F.asc("local_start")]


def stratified(rows: DataFrame, order: list, tie: str, per_bin, track: str = "track", bin: str = "bin_index", budget: str = "budget") -> DataFrame:
    """The ``budget`` best rows of each track, each bin's ``per_bin`` best coming first.

    A null budget takes all.  Two ranks say it: the place in the bin, and the
    place among all with the bins' best ahead.
    """
    in_bin = Window.partitionBy(track, bin).orderBy(*order, tie)
    ranked = rows.withColumn("bin_rank", F.row_number().over(in_bin)).withColumn("first_pick", F.col("bin_rank") <= per_bin)
    over_all = Window.partitionBy(track).orderBy(F.desc("first_pick"), *order, tie)
    ranked = ranked.withColumn("pick", F.row_number().over(over_all))
    return ranked.where(F.col(budget).isNull() | (F.col("pick") <= F.col(budget)))


def select(rows: DataFrame, cfg: AnchorSelection, track: str = "track") -> DataFrame:
    """The chosen anchors among the candidates without a rejection reason."""
    per_bin = F.lit(cfg.anchors_per_bin) if cfg.anchors_per_bin else F.ceil(F.col("budget") / F.greatest(F.col("bins"), F.lit(1)))
    return stratified(rows.where("rejection_reason IS NULL"), quality_order(), "segment_id", per_bin, track)


def bin_coverage(every: DataFrame, chosen: DataFrame, extents: DataFrame, track: str = "track") -> DataFrame:
    """(track, bin_index, start, end, candidates, selected) of every bin, empty ones too; ``extents``: track, total, bins."""
    width = F.col("total") / F.col("bins")
    grid = extents.select(track, "total", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin_index"))
    c = every.groupBy(track, "bin_index").agg(F.count("*").alias("candidates"))
    s = chosen.groupBy(track, "bin_index").agg(F.count("*").alias("selected"))
    end = F.when(F.col("bin_index") == F.col("bins") - 1, F.col("total")).otherwise((F.col("bin_index") + 1) * width)
    out = grid.join(c, [track, "bin_index"], "left").join(s, [track, "bin_index"], "left")
    return out.select(track, "bin_index", (F.col("bin_index") * width).alias("start"), end.alias("end"), *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("candidates", "selected")))


def coverage_warnings(coverage: DataFrame, gaps: DataFrame, extents: DataFrame, track: str = "track") -> DataFrame:
    """(track, code, time_seconds) where anchors are too concentrated; ``gaps`` from :func:`series.spans`."""
    bins = coverage.groupBy(track).agg(F.count("*").alias("n"), F.count_if(F.col("selected") > 0).alias("covered"), F.sum("selected").alias("chosen"))
    sparse = bins.where("n >= 3 AND covered < 3 AND chosen > 0").select(track, F.lit("SPARSE_ANCHOR_COVERAGE").alias("code"), F.lit(None).cast("double").alias("time_seconds"))
    limit = F.greatest(F.lit(120.0), F.col("total") * 0.5)
    wide = gaps.join(extents, track).where((F.col("total") >= 120.0) & (F.col("gap") > limit)).groupBy(track).agg(F.min("left").alias("time_seconds"))
    wide = wide.join(bins.where("chosen > 0").select(track), track).select(track, F.lit("LONG_UNANCHORED_SPAN").alias("code"), "time_seconds")
    return sparse.unionByName(wide)


def coverage(every: DataFrame, chosen: DataFrame, totals: DataFrame, cfg: AnchorSelection, track: str = "track") -> DataFrame:
    """The coverage warnings of a selection, from the candidates with their bins and each track's ``total``."""
    extents = every.select(track, "bins").distinct().join(totals.select(track, "total"), track).where("bins > 0")
    usable = every.where("rejection_reason IS NULL")
    middles = chosen.select(track, ((F.col("local_start") + F.col("local_end")) / 2.0).alias("midpoint"))
    gaps = spans(middles, extents.select(track, "total"), "midpoint", track)
    return coverage_warnings(bin_coverage(usable, chosen, extents, track), gaps, extents.select(track, "total"), track)


def selection_summary(every: DataFrame, chosen: DataFrame, coverage: DataFrame, gaps: DataFrame, track: str = "track") -> DataFrame:
    """One row for each track: counts, rejections by reason, durations of the chosen, longest gap."""
    reasons = every.where("rejection_reason IS NOT NULL").groupBy(track, "rejection_reason").agg(F.count("*").cast("int").alias("n"))
    reasons = reasons.groupBy(track).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rejection_reason", "n")))).alias("rejected_candidate_counts"))
    counts = every.groupBy(track).agg(F.count_if(F.col("rejection_reason").isNull()).alias("candidate_anchor_count"))
    picks = chosen.groupBy(track).agg(
        F.count("*").alias("selected_anchor_count"), F.min("duration_seconds").alias("duration_min"), F.median("duration_seconds").alias("duration_median"), F.max("duration_seconds").alias("duration_max")
    )
    sparse = coverage.groupBy(track).agg(F.count_if(F.col("selected") == 0).alias("sparse_bin_count"))
    longest = gaps.groupBy(track).agg(F.max("gap").alias("longest_unanchored_span_seconds"))
    return counts.join(picks, track, "left").join(reasons, track, "left").join(sparse, track, "left").join(longest, track, "left")


