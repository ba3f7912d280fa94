"""Event-time forms of the sequence operators for unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """``rows`` with ``ts`` as a timestamp that watermarks accept, and a watermark if ``delay`` is given."""
    out = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay else out


def hopping_energy(rows: DataFrame, length: str, hop: str, ts: str = "ts", track: str = "track", value: str = "v", delay: str | None = None) -> DataFrame:
    """(track, start, n, energy) of overlapping windows of event time."""
    v = F.col(value).cast("double")
    grouped = timed(rows, ts, delay).groupBy(F.col(track), F.window(ts, length, hop).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sqrt(F.avg(v * v) + 1e-12).alias("energy")).select(track, F.col("w.start").alias("start"), "n", "energy")


def sessions(rows: DataFrame, gap: str, ts: str = "ts", track: str = "track", delay: str | None = None) -> DataFrame:
    """(track, start, end, n): active intervals, ended by ``gap`` without an event."""
    grouped = timed(rows, ts, delay).groupBy(F.col(track), F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(track, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
