"""Active intervals of a series: frame energies against a fixed or an adaptive threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp01
from .series import frame_energy, runs

#: Fixed values of the strategies.
FIXED_THRESHOLD = 0.02
NOISE_PERCENTILE, MAD_SCALE, ENERGY_FLOOR, LEAST_MAD = 0.2, 1.0, 1e-4, 1e-3
#: Energies this close (relatively) are equal: sums differ in their last digits with their order.
EQUAL = 1e-9
#: Mean energy of a run that counts as full confidence.
FULL_ENERGY = 0.1


def frame_sizes(sample_rate: int, frame_ms: float = 30.0, hop_ms: float = 10.0) -> tuple[int, int]:
    return max(1, int(sample_rate * frame_ms / 1000.0)), max(1, int(sample_rate * hop_ms / 1000.0))


def adaptive_threshold(energies: DataFrame, track: str = "track", mad_scale: float = MAD_SCALE) -> DataFrame:
    """(track, noise_floor, mad, threshold): the quiet frames' level, raised by their spread where there is any.

    Percentiles are exact; each aggregate keeps one track's distinct energies.
    """
    floors = energies.groupBy(track).agg(F.percentile("energy", F.lit(NOISE_PERCENTILE)).alias("noise_floor"))
    quiet = energies.join(floors, track).where(F.col("energy") <= F.col("noise_floor") * (1 + EQUAL))
    centre = quiet.groupBy(track).agg(F.median("energy").alias("centre"))
    mad = quiet.join(centre, track).groupBy(track).agg(F.median(F.abs(F.col("energy") - F.col("centre"))).alias("mad"))
    level = F.col("noise_floor") + F.when(F.col("mad") < LEAST_MAD, 0.0).otherwise(F.col("mad") * mad_scale)
    return floors.join(mad, track).withColumn("threshold", F.greatest(F.lit(ENERGY_FLOOR), level))


def segments(energies: DataFrame, hop: int, sample_rate: float, min_seconds: float = 0.3, full_energy: float = FULL_ENERGY, track: str = "track") -> DataFrame:
    """(track, start, end, confidence) of the runs of frames at or above ``threshold`` (a column)."""
    found = runs(energies, F.col("energy") >= F.col("threshold") * (1 - EQUAL), "frame", track).groupBy(track, "run")
    spans = found.agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.avg("energy").alias("mean_energy"))
    start, end = F.col("f0") * hop / F.lit(float(sample_rate)), (F.col("f1") * hop + hop) / F.lit(float(sample_rate))
    out = spans.select(track, start.alias("start"), end.alias("end"), clamp01(F.col("mean_energy") / full_energy).alias("confidence"))
    return out.where(F.col("end") - F.col("start") >= min_seconds)


def detect_adaptive(samples: DataFrame, sample_rate: int, frame_ms: float = 30.0, hop_ms: float = 10.0, min_ms: float = 300.0, track: str = "track", full_energy: float = FULL_ENERGY) -> DataFrame:
    """Active intervals against each track's own noise level."""
    frame, hop = frame_sizes(sample_rate, frame_ms, hop_ms)
    e = frame_energy(samples, frame, hop, track)
    judged = e.join(adaptive_threshold(e, track).select(track, "threshold"), track)
    return segments(judged, hop, sample_rate, min_ms / 1000.0, full_energy, track)


def detect_fixed(samples: DataFrame, sample_rate: int, threshold: float = FIXED_THRESHOLD, frame_ms: float = 30.0, hop_ms: float = 10.0, min_ms: float = 300.0, track: str = "track", full_energy: float = FULL_ENERGY) -> DataFrame:
    """Active intervals against one threshold."""
    frame, hop = frame_sizes(sample_rate, frame_ms, hop_ms)
    judged = frame_energy(samples, frame, hop, track).withColumn("threshold", F.lit(float(threshold)))
    return segments(judged, hop, sample_rate, min_ms / 1000.0, full_energy, track)


_STRATEGIES: dict[str, Callable[..., DataFrame]] = {"adaptive_rms": detect_adaptive, "rms": detect_fixed}
#: Strategies whose models or native code are not part of this package.
EXTERNAL = ("silero", "webrtc", "pyannote")


def register_strategy(name: str, detect: Callable[..., DataFrame]) -> None:
    """Add a detector ``(samples, sample_rate, **options) -> (track, start, end, confidence)``."""
    _STRATEGIES[name] = detect


def detect(samples: DataFrame, sample_rate: int, strategy: str = "rms", **options) -> DataFrame:
    """Active intervals by a named strategy."""
    if strategy not in _STRATEGIES:
        if strategy in EXTERNAL:
            raise RuntimeError(f"the {strategy} strategy needs a detector of its own: register_strategy({strategy!r}, ...)")
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(_STRATEGIES)}")
    return _STRATEGIES[strategy](samples, sample_rate, **options)
