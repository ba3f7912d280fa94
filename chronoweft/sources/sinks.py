"""What a run leaves behind: series, the report, markers, warnings, the pack of test cases."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import MARKER_COLUMNS, markers, warning_line
from .wav import file_system, pcm, wav_head

#: Silent samples that are written at a time.
SILENCE = 1 << 16


def write_wavs(samples: DataFrame, sample_rate: int, path: str) -> DataFrame:
    """One ``<track>.wav`` for each track of ``samples`` (track, idx, v) below ``path``; gaps are silent.

    Written where the rows are: each task streams its tracks' sorted samples, a
    batch at a time, to a file that gets its name when it is whole.  Returns
    (track, path, frames) of the files.
    """
    rows = samples.select(F.col("track").cast("string").alias("track"), F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    sized = rows.join(rows.groupBy("track").agg((F.max("idx") + 1).alias("n")), "track")
    sized = sized.repartition("track").sortWithinPartitions("track", "idx").select("track", "idx", "v", "n")
    root = path.rstrip("/")

    def run(batches):
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out, track, at, n, temporary = None, None, 0, 0, ""

        def silent(upto):
            nonlocal at
            while at < upto:
                step = min(SILENCE, upto - at)
                out.write(bytes(2 * step))
                at += step

        def closed():
            silent(n)
            out.close()
            fs.move(f"{base}/{temporary}", f"{base}/{track}.wav")
            return pa.RecordBatch.from_arrays([pa.array([track]), pa.array([f"{root}/{track}.wav"]), pa.array([n], pa.int64())], names=["track", "path", "frames"])

        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for r in np.split(np.arange(len(names)), np.flatnonzero(names[1:] != names[:-1]) + 1):
                if not len(r):
                    continue
                if names[r[0]] != track:
                    if out:
                        yield closed()
                    track, at, n = names[r[0]], 0, b.column(3)[int(r[0])].as_py()
                    temporary = f".{track}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/{temporary}")
                    out.write(wav_head(n, sample_rate))
                idx, v = b.column(1).to_numpy()[r], b.column(2).to_numpy(zero_copy_only=False)[r]
                for run_ in np.split(np.arange(len(idx)), np.flatnonzero(np.diff(idx) != 1) + 1):
                    silent(int(idx[run_[0]]))
                    out.write(pcm(v[run_]))
                    at = int(idx[run_[-1]]) + 1
        if out:
            yield closed()

    done = sized.mapInArrow(run, "track string, path string, frames long")
    # writing is the action; the few rows that it gives, one for each file, are kept
    return samples.sparkSession.createDataFrame(done.collect(), "track string, path string, frames long")


def write_report(document: DataFrame, path: str) -> None:
    """The report as the single file ``path``: the lines of :func:`report.document`, sorted by the
    cluster and then joined by its file system."""
    spark = document.sparkSession
    parts = f"{path}-{uuid.uuid4().hex}"
    document.orderBy("part", "track", "place", "line").select("line").write.text(parts)
    fs = spark._jvm.org.apache.hadoop.fs
    conf, where, folder = spark._jsc.hadoopConfiguration(), fs.Path(path), fs.Path(parts)
    system = where.getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    out = system.create(where, True)
    try:
        for n in names:
            part = system.open(fs.Path(folder, n))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    system.delete(folder, True)


def write_markers(matches: DataFrame | None, path: str, reports: DataFrame | None = None) -> None:
    """The markers as CSV with a header.

    Compact reports count their matches but don't hold them: without
    ``matches`` a report that counts some is an error.
    """
    if matches is None:
        count = F.get_json_object("report", "$.drift_anchor_match_summary.count").cast("long")
        if reports is not None and not reports.where(count > 0).isEmpty():
            raise ValueError("the compact report doesn't hold the matches that it counts: give them, or ask for a verbose one")
        matches = reports.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'track' else 'double'}" for c in MARKER_COLUMNS))
    markers(matches).select(*MARKER_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_pack(spark: SparkSession, path: str, sample_rate: int = 8000, seconds: float = 24.0, master_seconds: float = 27.0) -> dict:
    """The generated test cases: a reference and a local series as WAV for each, and ``manifest.json``."""
    from . import synthetic

    local = synthetic.program(spark, sample_rate, seconds)
    cases = []
    for name, (mapping, dropout) in synthetic.CASES.items():
        heard = synthetic.heard(local, mapping, sample_rate, master_seconds, dropout)
        both = heard.select(F.lit("master").alias("track"), "idx", "v").unionByName(local.select(F.lit("local").alias("track"), "idx", "v"))
        write_wavs(both, sample_rate, f"{path}/{name}")
        cases.append({"case": name, "master": f"{name}/master.wav", "local": f"{name}/local.wav", "sample_rate": sample_rate, "duration_seconds": seconds, "dropout": dropout})
    manifest = {"note": "Generated test cases; nobody's recordings.", "cases": cases}
    fs, at = file_system(f"{path}/manifest.json")
    with fs.open_output_stream(at) as f:
        f.write((json.dumps(manifest, indent=2) + "\n").encode())
    return manifest


def write_warnings(issues: DataFrame, path: str) -> None:
    """A line for each issue, by track and in order."""
    issues.orderBy("track", "seq").select(warning_line().alias("value")).write.mode("overwrite").text(path)
