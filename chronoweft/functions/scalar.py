"""Scalar rules of the engine as Column expressions: ramps, bands, ladders, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnchorMatching, AnchorSelection, OffsetSafety


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(x) -> Column:
    """Held within 0 and 1; null stays null (``least`` and ``greatest`` alone would pass over it)."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x))))


def ramp(x, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, linear between; a step at ``low`` if the two coincide."""
    if high - low <= 1e-15:
        return F.when(col(x) >= low, 1.0).otherwise(0.0)
    return clamp01((col(x) - F.lit(low)) / F.lit(high - low))


def micro(x) -> Column:
    """Rounded to six places by floor, which every engine computes alike."""
    return F.floor(col(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def truncated(x) -> Column:
    """Toward zero, as a long."""
    return col(x).cast("double").cast("long")


def half_even(x) -> Column:
    """To the nearest whole number, halves to the even one, as a long."""
    return F.rint(col(x)).cast("long")


def root_mean_square(mean_square, floor: float = 1e-18) -> Column:
    return F.sqrt(col(mean_square) + F.lit(floor))


# Anchor duration and confidence --------------------------------------------


def snr_stretch(snr) -> Column:
    """How much longer an anchor gets for a weak signal: 1 from 24 dB on, 2 below 6."""
    s = col(snr)
    return (
        F.when(s.isNull() | (s >= 24.0), 1.0)
        .when(s >= 12.0, 1.0 + (24.0 - s) / 12.0 * 0.5)
        .when(s >= 6.0, 1.5 + (12.0 - s) / 6.0 * 0.5)
        .otherwise(2.0)
    )


def flatness_stretch(flatness) -> Column:
    """The same for noise-like material; jumps from 1.5 to 2 above 0.65."""
    f = col(flatness)
    return F.when(f <= 0.25, 1.0).when(f <= 0.65, 1.0 + (f - 0.25) / 0.40 * 0.5).otherwise(2.0)


def anchor_rejection(available, snr, flatness, cfg: AnchorSelection) -> Column:
    """Why a segment gives no anchor, or null."""
    out = F.when(col(available) < cfg.min_anchor_duration_seconds, "too_short")
    if cfg.min_snr_db is not None:
        out = out.when(col(snr) < cfg.min_snr_db, "low_snr")
    if cfg.spectral_flatness_threshold is not None:
        out = out.when(col(flatness) > cfg.spectral_flatness_threshold, "spectrally_flat")
    return out


def requested_duration(snr, flatness, cfg: AnchorSelection) -> Column:
    stretch = F.greatest(snr_stretch(snr), flatness_stretch(flatness))
    return F.greatest(F.lit(cfg.min_anchor_duration_seconds), F.least(F.lit(cfg.max_anchor_duration_seconds), stretch * cfg.base_anchor_duration_seconds))


def confidence_scale(available, snr, flatness, cfg: AnchorSelection) -> Column:
    """What weak, flat or short material takes from an anchor's confidence."""
    s, f, want = col(snr), col(flatness), requested_duration(snr, flatness, cfg)
    got = F.least(col(available), want)
    by_snr = F.when(s < 6.0, 0.65).when(s < 12.0, 0.85).otherwise(1.0)
    by_flatness = F.when(f > 0.75, 0.65).when(f > 0.45, 0.85).otherwise(1.0)
    return by_snr * by_flatness * F.when(got < want, F.greatest(F.lit(0.5), got / want)).otherwise(1.0)


def bin_of(midpoint, duration, bins) -> Column:
    """Stratum of a time, 0 to ``bins - 1``."""
    d, b = col(duration), col(bins)
    raw = F.when((b <= 1) | (d <= 0), 0).otherwise(truncated(F.try_divide(col(midpoint), d) * b))
    return F.greatest(F.lit(0), F.least(b - 1, raw)).cast("int")


def anchor_budget(duration, cfg: AnchorSelection) -> Column:
    """Anchors wanted for a duration; null for no bound."""
    if cfg.max_anchor_count is None:
        return F.lit(None).cast("int")
    wanted = F.ceil(col(duration) / 60.0 * cfg.anchor_density_per_minute)
    return F.least(F.greatest(F.lit(cfg.min_anchor_count), wanted), F.lit(cfg.max_anchor_count)).cast("int")


def bin_count(duration, budget, cfg: AnchorSelection) -> Column:
    if cfg.stratified_bin_count is not None:
        return F.lit(int(cfg.stratified_bin_count))
    minutes = F.ceil(col(duration) / 60.0)
    return F.greatest(F.lit(1), F.least(F.coalesce(col(budget), minutes), minutes)).cast("int")


# Match confidence -----------------------------------------------------------


def peak_quality(best, cfg: AnchorMatching) -> Column:
    return ramp(best, cfg.ncc_min_score, 1.0)


def peak_uniqueness(margin, prominence, cfg: AnchorMatching) -> Column:
    """How far the best peak stands out; a strong prominence forgives a small margin."""
    by_prominence = ramp(prominence, cfg.ncc_prominence_low, cfg.ncc_prominence_high)
    lenient = ramp(margin, cfg.ncc_margin_low * 0.4, cfg.ncc_margin_high)
    strict = ramp(margin, cfg.ncc_margin_low, cfg.ncc_margin_high)
    by_margin = F.when(col(prominence) >= cfg.ncc_prominence_high, lenient).otherwise(strict)
    return F.when(col(margin).isNull(), by_prominence).otherwise(F.least(by_margin, by_prominence))


def peak_sharpness(width_samples, sample_rate: float, cfg: AnchorMatching) -> Column:
    seconds = col(width_samples) / F.lit(max(1.0, float(sample_rate)))
    good, bad = cfg.ncc_good_width_seconds, cfg.ncc_bad_width_seconds
    if bad - good <= 1e-15:
        return F.when(seconds <= good, 1.0).otherwise(0.0)
    return F.lit(1.0) - ramp(seconds, good, bad)


def gate_reason(best, margin, prominence, cfg: AnchorMatching) -> Column:
    """The first hard gate that a peak fails, or null."""
    return (
        F.when(col(best) < cfg.ncc_min_score, "ncc_best_score_below_min")
        .when(col(margin) < cfg.ncc_min_margin, "ncc_margin_below_min")
        .when(col(prominence) < cfg.ncc_min_prominence, "ncc_prominence_below_min")
    )


def is_ambiguous(best, margin, prominence, cfg: AnchorMatching) -> Column:
    """Whether a second correlation is worth its cost."""
    thin = (col(margin) < 2.0 * cfg.ncc_min_margin) & (col(prominence) < 5.0 * cfg.ncc_min_prominence)
    return gate_reason(best, margin, prominence, cfg).isNotNull() | F.coalesce(thin, F.lit(False)) | (col(prominence) < 2.0 * cfg.ncc_min_prominence)


def agreement(gcc_peak, lag_gap_seconds, cfg: AnchorMatching) -> Column:
    """1 where no second correlation ran, falling with the distance of its lag, 0 where it is no evidence."""
    gap, tol = F.abs(col(lag_gap_seconds)), cfg.gcc_phat_agreement_tolerance_seconds
    counts = (col(gcc_peak) >= 0.05) & (gap <= 3.0 * tol)
    return F.when(col(gcc_peak).isNull(), 1.0).when(counts, clamp01(1.0 - gap / tol)).otherwise(0.0)


def match_confidence(anchor, quality, uniqueness, sharpness, agree) -> Column:
    return clamp01(col(anchor) * col(quality) * col(uniqueness) * col(sharpness) * col(agree))


# Initial offset -------------------------------------------------------------


def offset_confidence(score, anchor_confidence) -> Column:
    return clamp01((col(score) + 1.0) / 2.0) * col(anchor_confidence)


def confidence_band(confidence, cfg: OffsetSafety) -> Column:
    c = col(confidence)
    return (
        F.when(c >= cfg.high_confidence_threshold, "high")
        .when(c >= cfg.medium_confidence_threshold, "medium")
        .when(c >= cfg.low_confidence_threshold, "low")
        .otherwise("failed")
    )


#: Why a search radius is what it is, by band, without and with the fallback's estimate.
RADIUS_REASONS = {
    "high": ("high_confidence_anchor_estimate", "high_confidence_fallback_selected"),
    "medium": ("medium_confidence_anchor_estimate", "medium_confidence_fallback_selected"),
    "low": ("low_confidence_no_fallback_selected", "low_confidence_fallback_selected"),
}
NO_RADIUS_REASON = "no_usable_initial_estimate"


def search_radius(band, fallback_selected, usable, cfg: OffsetSafety) -> Column:
    """Struct (radius, reason) of the drift search around an offset; a failed band that is still usable counts as low."""
    level = F.when(col(band).isin("high", "medium"), col(band)).otherwise("low")
    radius, reason = F.lit(0.0), F.lit(NO_RADIUS_REASON)
    for name, (plain, fallback) in RADIUS_REASONS.items():
        here = col(usable) & (level == name)
        seconds = min(getattr(cfg, f"{name}_confidence_search_radius_seconds"), cfg.max_drift_search_radius_seconds)
        radius = F.when(here, float(seconds)).otherwise(radius)
        reason = F.when(here, F.when(col(fallback_selected), fallback).otherwise(plain)).otherwise(reason)
    return F.struct(radius.cast("double").alias("radius"), reason.alias("reason"))


def fallback_accepted(confidence, margin, anchor_confidence, cfg: OffsetSafety) -> Column:
    enough = (col(confidence) >= cfg.coarse_fallback_min_confidence) & F.coalesce(col(margin) >= cfg.coarse_fallback_min_peak_margin, F.lit(True))
    ahead = col(confidence) - col(anchor_confidence) >= cfg.coarse_fallback_confidence_margin
    return enough & (ahead | (confidence_band(anchor_confidence, cfg) == "failed"))


def _digits(c: Column) -> Column:
    """Three digits, halves to the even one."""
    return F.format_string("%.3f", F.rint(c * 1000.0) / 1000.0)


def fallback_objections(confidence, margin, anchor_confidence, cfg: OffsetSafety) -> Column:
    """What speaks against a fallback, ``; `` between the reasons; empty if nothing does."""
    c, m = col(confidence), col(margin)
    rated = (("confidence", c, cfg.coarse_fallback_min_confidence), ("peak margin", m, cfg.coarse_fallback_min_peak_margin), ("gain over the anchors", c - col(anchor_confidence), cfg.coarse_fallback_confidence_margin))
    return F.concat_ws("; ", *(F.when(got < need, F.concat(F.lit(f"{name} "), _digits(got), F.lit(f" is below {need:.3f}"))) for name, got, need in rated))


def fallback_cap(local_duration, master_duration, cfg: OffsetSafety) -> Column:
    """Struct (cap, memory_limited): seconds that the whole-recording correlation may use; null for all."""
    arrays, bytes_each, overhead = 3, 8, 8.0
    memory = int(cfg.coarse_fallback_max_memory_mb * 1024 * 1024 / bytes_each / arrays) / (overhead * cfg.coarse_fallback_sample_rate)
    longest = F.greatest(col(local_duration), col(master_duration))
    limited = F.lit(memory) < longest
    explicit = cfg.coarse_fallback_max_duration_seconds
    if explicit is None:
        cap, by_memory = F.when(limited, memory), limited
    else:
        least = min(explicit, memory)
        cap, by_memory = F.when(F.lit(least) < longest, least), limited & F.lit(memory <= explicit)
    return F.struct(cap.cast("double").alias("cap"), by_memory.alias("memory_limited"))


# Output ---------------------------------------------------------------------


def pcm16(x, peak) -> Column:
    """A sample as 16-bit PCM, scaled down where the recording's peak passes one."""
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(x) / F.greatest(col(peak), F.lit(1.0))))
    return truncated(scaled * 32767.0).cast("short")


def event_confidence(residual_ms) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.abs(col(residual_ms)) / 300.0))
