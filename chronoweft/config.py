"""Options of the engine: frozen, validated on construction."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class _Options:
    def as_dict(self) -> dict:
        return asdict(self)

    def _finite(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, float):
                _need(math.isfinite(v), f"{f.name} must be finite")


@dataclass(frozen=True)
class OffsetSafety(_Options):
    """Initial offset: confidence bands, coarse fallback, search radii, reference-activity filter."""

    initial_offset_min_confidence: float = 0.50
    high_confidence_threshold: float = 0.75
    medium_confidence_threshold: float = 0.50
    low_confidence_threshold: float = 0.25
    coarse_fallback_enabled: bool = True
    coarse_fallback_sample_rate: int = 8000
    coarse_fallback_min_peak_margin: float = 0.10
    coarse_fallback_max_duration_seconds: float | None = None
    coarse_fallback_max_memory_mb: float = 1024.0
    coarse_fallback_min_confidence: float = 0.50
    coarse_fallback_confidence_margin: float = 0.15
    max_drift_search_radius_seconds: float = 30.0
    high_confidence_search_radius_seconds: float = 6.0
    medium_confidence_search_radius_seconds: float = 12.0
    low_confidence_search_radius_seconds: float = 20.0
    master_vad_filter_enabled: bool = True
    master_vad_min_overlap_ratio: float = 0.25
    master_vad_padding_seconds: float = 0.25
    master_vad_uncertain_policy: str = "warn"

    def __post_init__(self) -> None:
        self._finite()
        low, med, high = self.low_confidence_threshold, self.medium_confidence_threshold, self.high_confidence_threshold
        _need(0 < low < med < high < 1, "confidence thresholds must rise within (0, 1)")
        _need(low <= self.initial_offset_min_confidence <= 1, "initial_offset_min_confidence must reach the low threshold")
        _need(self.coarse_fallback_sample_rate > 0 and self.coarse_fallback_max_memory_mb > 0, "coarse fallback limits must be positive")
        cap = self.coarse_fallback_max_duration_seconds
        _need(cap is None or cap > 0, "coarse_fallback_max_duration_seconds must be positive")
        for n in ("max_drift", "high_confidence", "medium_confidence", "low_confidence"):
            _need(getattr(self, f"{n}_search_radius_seconds") > 0, f"{n}_search_radius_seconds must be positive")
        _need(0 <= self.master_vad_min_overlap_ratio <= 1, "master_vad_min_overlap_ratio must be in [0, 1]")
        _need(self.master_vad_padding_seconds >= 0, "master_vad_padding_seconds must not be negative")
        _need(self.master_vad_uncertain_policy in ("warn", "skip", "reject"), "unknown master_vad_uncertain_policy")


MODELS = ("auto", "linear", "piecewise_linear", "spline", "kalman")


@dataclass(frozen=True)
class DriftModel(_Options):
    """Which time map is fitted, and what a richer one must achieve."""

    drift_model: str = "auto"
    allow_nonlinear_drift: bool = False
    min_anchors_for_piecewise: int = 6
    min_anchors_per_segment: int = 3
    max_breakpoints: int = 1
    min_residual_improvement_ms: float = 5.0
    min_relative_residual_improvement: float = 0.2
    max_abs_rate_deviation_ppm: float = 1000.0
    max_rate_change_ppm: float = 500.0
    warn_abs_rate_deviation_ppm: float = 200.0
    max_anchor_gap_seconds: float | None = None
    monotonicity_rate_epsilon: float = 1e-9
    min_anchors_for_spline: int = 6
    spline_knot_source: str = "auto"
    min_knot_spacing_seconds: float = 30.0
    spline_validation_sample_count: int = 1024
    min_anchors_for_kalman: int = 5
    kalman_process_offset_noise_ms: float = 5.0
    kalman_process_rate_noise_ppm: float = 50.0
    kalman_observation_noise_ms: float = 30.0
    kalman_initial_offset_uncertainty_ms: float = 250.0
    kalman_initial_rate_uncertainty_ppm: float = 500.0
    kalman_validation_sample_count: int = 1024

    def __post_init__(self) -> None:
        self._finite()
        _need(self.drift_model in MODELS, "unknown drift_model")
        _need(self.allow_nonlinear_drift or self.drift_model in ("auto", "linear"), f"{self.drift_model} needs allow_nonlinear_drift")
        _need(self.max_breakpoints >= 0, "max_breakpoints must not be negative")
        _need(self.monotonicity_rate_epsilon >= 0, "monotonicity_rate_epsilon must not be negative")
        gap = self.max_anchor_gap_seconds
        _need(gap is None or gap > 0, "max_anchor_gap_seconds must be positive")
        _need(self.spline_knot_source in ("auto", "piecewise_boundaries", "anchors"), "unknown spline_knot_source")
        if self.allow_nonlinear_drift:
            _need(self.min_anchors_per_segment >= 2, "min_anchors_per_segment must be at least 2")
            _need(self.min_anchors_for_spline >= 3 and self.min_knot_spacing_seconds > 0, "spline options out of range")
            _need(self.spline_validation_sample_count >= 2 and self.kalman_validation_sample_count >= 2, "validation needs two samples")
            _need(self.min_anchors_for_kalman >= 2, "min_anchors_for_kalman must be at least 2")
            for f in fields(self):
                if f.name.startswith("kalman_") and f.type == "float":
                    _need(getattr(self, f.name) > 0, f"{f.name} must be positive")

    def as_dict(self) -> dict:
        resolved = "linear" if not self.allow_nonlinear_drift else self.drift_model
        policy = "linear_default" if resolved == "linear" else "nonlinear_experimental"
        return asdict(self) | {"resolved_model": resolved, "selection_policy": policy}


@dataclass(frozen=True)
class AnchorSelection(_Options):
    """How many anchors, how long, and how spread."""

    anchor_density_per_minute: float = 1.0
    max_anchor_density_per_minute: float = 2.0
    min_anchor_count: int = 5
    max_anchor_count: int | None = 120
    stratified_bin_count: int | None = None
    anchors_per_bin: int | None = None
    min_anchor_duration_seconds: float = 1.0
    base_anchor_duration_seconds: float = 4.0
    max_anchor_duration_seconds: float = 8.0
    min_snr_db: float | None = None
    spectral_flatness_threshold: float | None = None

    def __post_init__(self) -> None:
        self._finite()
        _need(0 < self.anchor_density_per_minute <= self.max_anchor_density_per_minute, "anchor densities out of order")
        _need(self.min_anchor_count >= 0, "min_anchor_count must not be negative")
        _need(self.max_anchor_count is None or self.max_anchor_count >= 0, "max_anchor_count must not be negative")
        for n in ("stratified_bin_count", "anchors_per_bin"):
            v = getattr(self, n)
            _need(v is None or v > 0, f"{n} must be positive")
        low, base, high = self.min_anchor_duration_seconds, self.base_anchor_duration_seconds, self.max_anchor_duration_seconds
        _need(0 < low <= base <= high, "anchor durations out of order")
        flat = self.spectral_flatness_threshold
        _need(flat is None or 0 <= flat <= 1, "spectral_flatness_threshold must be in [0, 1]")


@dataclass(frozen=True)
class AnchorMatching(_Options):
    """When a correlation peak is a match, and how much it counts."""

    nms_exclusion_seconds: float = 0.05
    ncc_min_score: float = 0.45
    ncc_min_margin: float = 0.10
    ncc_min_prominence: float = 0.06
    ncc_good_width_seconds: float = 0.005
    ncc_bad_width_seconds: float = 0.050
    ncc_margin_low: float = 0.05
    ncc_margin_high: float = 0.20
    ncc_prominence_low: float = 0.03
    ncc_prominence_high: float = 0.15
    gcc_phat_enabled: bool = True
    gcc_phat_only_when_ambiguous: bool = True
    gcc_phat_agreement_tolerance_seconds: float = 0.030
    min_confidence_for_fit: float = 0.05

    def __post_init__(self) -> None:
        self._finite()
        _need(self.nms_exclusion_seconds > 0, "nms_exclusion_seconds must be positive")
        _need(-1 <= self.ncc_min_score <= 1, "ncc_min_score must be in [-1, 1]")
        _need(0 <= self.ncc_good_width_seconds <= self.ncc_bad_width_seconds, "peak widths out of order")
        _need(self.ncc_margin_low <= self.ncc_margin_high, "margins out of order")
        _need(self.ncc_prominence_low <= self.ncc_prominence_high, "prominences out of order")
        _need(self.gcc_phat_agreement_tolerance_seconds > 0, "gcc_phat_agreement_tolerance_seconds must be positive")
        _need(0 <= self.min_confidence_for_fit <= 1, "min_confidence_for_fit must be in [0, 1]")
