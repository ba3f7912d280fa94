"""Recordings as series: WAV and AIFF files, read by byte ranges in blocks.

Spark lists the files without their contents.  A header is read from a file's
first bytes, and every block of frames is a row that a task reads, decodes and
mixes to mono by itself, so a file of any length is spread over the tasks and
none holds it whole.  PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits
are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import resample, resample_reach

#: Frames of a block (a chunk row).
CHUNK = 262_144
SUFFIXES = ("wav", "aiff", "aif")
#: Bytes that are read at first to find the header; twice as many again and again if it is longer.
HEAD = 4096
_SIZES = {"kind": "int", "channels": "int", "rate": "int", "bits": "int", "big": "boolean", "start": "long", "frames": "long"}


class SeriesError(ValueError):
    """A file that cannot be read as a series."""


def _extended(b: bytes) -> float:
    """An 80-bit float, as AIFF files give their sample rate."""
    exponent, mantissa = struct.unpack(">HQ", b[:10])
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def header(blob: bytes) -> dict:
    """rate, channels, bits, kind (1 PCM, 3 float), big (end first), frames, and where the samples start.

    ``blob`` are a file's first bytes; EOFError if they end before the samples begin.
    """
    riff = blob[:4] == b"RIFF" and blob[8:12] == b"WAVE"
    if not riff and not (blob[:4] == b"FORM" and blob[8:12] in (b"AIFF", b"AIFC")):
        raise SeriesError("neither a RIFF/WAVE nor an AIFF file")
    at, out = 12, {}
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I" if riff else ">I", blob, at + 4)[0]
        body = blob[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE:  # extensible: the kind is in the sub-format
                kind = struct.unpack_from("<H", body, 24)[0]
            out = {"kind": kind, "channels": channels, "rate": rate, "bits": bits, "big": False}
        elif name == b"COMM":
            channels, _, bits = struct.unpack_from(">hIh", body)
            code = body[18:22] or b"NONE"
            if code not in (b"NONE", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
                raise SeriesError(f"compressed samples: {code!r}")
            out = {"kind": 3 if code[:2].lower() == b"fl" else 1, "channels": channels, "rate": int(round(_extended(body[8:18]))), "bits": bits, "big": code != b"sowt"}
        elif name in (b"data", b"SSND"):
            if not out:
                break
            skip = 0 if riff else 8 + struct.unpack_from(">I", blob, at + 8)[0]
            return out | {"start": at + 8 + skip, "frames": (size - skip) // (out["channels"] * out["bits"] // 8)}
        at += 8 + size + size % 2
    if at + 8 > len(blob) and at > 12:
        raise EOFError(at + 8)
    raise SeriesError("no samples in the file")


def decode(blob: bytes, h: dict | None = None, whole: bool = True) -> np.ndarray:
    """Samples as floats, frames by channels, scaled to -1..1; of a file's bytes, or of a block of its frames."""
    if h is None:
        try:
            h = header(blob)
        except EOFError as e:
            raise SeriesError("no samples in the file") from e
    n, start = h["frames"] * h["channels"], h["start"] if whole else 0
    raw = memoryview(blob)[start : start + n * h["bits"] // 8]
    if len(raw) < n * h["bits"] // 8:
        raise SeriesError(f"the header says {h['frames']} frames, the file has fewer")
    end = ">" if h["big"] else "<"
    if h["kind"] == 3:
        x = np.frombuffer(raw, {32: f"{end}f4", 64: f"{end}f8"}[h["bits"]]).astype(np.float64)
    elif h["bits"] == 8:
        x = np.frombuffer(raw, np.int8) / 128.0 if h["big"] else (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif h["bits"] == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if h["big"] else b
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif h["bits"] in (16, 32):
        x = np.frombuffer(raw, f"{end}i{h['bits'] // 8}") / float(1 << (h["bits"] - 1))
    else:
        raise SeriesError(f"{h['bits']} bits are not supported")
    return x.reshape(-1, h["channels"])


def pcm(x: np.ndarray) -> bytes:
    """16-bit samples; held within -1 and 1."""
    return np.rint(np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2").tobytes()


def wav_head(frames: int, rate: int) -> bytes:
    """The bytes before the samples of a mono 16-bit file."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16)
    return b"RIFF" + struct.pack("<I", 4 + len(fmt) + 8 + 2 * frames) + b"WAVE" + fmt + b"data" + struct.pack("<I", 2 * frames)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A mono series as a 16-bit PCM file."""
    return wav_head(len(x), rate) + pcm(x)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark names, and the path on it."""
    local = re.match(r"^(?:file:)?/+(?!/)(.*)$", uri)
    return (pafs.LocalFileSystem(), "/" + local.group(1)) if local else pafs.FileSystem.from_uri(uri)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*SUFFIXES))
    return found.withColumn("track", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))


def _read_header(f, length: int) -> dict:
    size = HEAD
    while True:
        f.seek(0)
        try:
            return header(f.read(min(size, length)))
        except EOFError as e:
            if size >= length:
                raise SeriesError("no samples in the file") from e
            size = max(2 * size, int(e.args[0]) + 64)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    schema = "track string, path string, " + ", ".join(f"{n} {t}" for n, t in _SIZES.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for track, where, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, at = file_system(where)
                with fs.open_input_file(at) as f:
                    rows.append({"track": track, "path": where} | _read_header(f, length))
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
            fields = [("track", pa.string()), ("path", pa.string()), *((n, kinds[t]) for n, t in _SIZES.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return _files(spark, path).select("track", "path", "length").mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(track, path, sample_rate, channels, frames, duration_seconds) of every file below ``path``."""
    h = _headers(spark, path)
    return h.select("track", "path", F.col("rate").alias("sample_rate"), "channels", "frames", (F.col("frames") / F.col("rate")).alias("duration_seconds"))


def read_series(spark: SparkSession, path: str, sample_rate: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(track, chunk, first, sample_rate, values): mono series, resampled if a rate is given, a row for each block of frames.

    ``first`` is the number of a row's first sample.  A block that is resampled
    reads as many frames more on either side as the filter reaches.  A file with
    fewer frames than its header says is an error.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("frames") - 1) / chunk)))
    wanted = _headers(spark, path).where("frames > 0").withColumn("chunk", blocks)
    names = ["track", "chunk", "path", *_SIZES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rate = sample_rate or row["rate"]
                i0, i1 = row["chunk"] * chunk, min(row["frames"], (row["chunk"] + 1) * chunk)
                reach = resample_reach(row["rate"], rate)
                a, z = max(0, i0 - reach), min(row["frames"], i1 + reach)
                frame = row["channels"] * row["bits"] // 8
                fs, at = file_system(row["path"])
                with fs.open_input_file(at) as f:
                    f.seek(row["start"] + a * frame)
                    raw = f.read((z - a) * frame)
                x = decode(raw, row | {"frames": z - a}, whole=False).mean(axis=1)
                first, x = resample(x, row["rate"], rate, (a, i0, i1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["track"]]), pa.array([row["chunk"]], pa.int64()), pa.array([first], pa.int64()), pa.array([rate], pa.int32()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))],
                    names=["track", "chunk", "first", "sample_rate", "values"],
                )

    spread = wanted.select(*names).repartition(F.col("path"), F.col("chunk"))
    return spread.mapInArrow(run, "track string, chunk long, first long, sample_rate int, values array<float>")


def samples_of(chunks: DataFrame) -> DataFrame:
    """(track, idx, v): chunk rows as single samples."""
    rows = chunks.select("track", "first", F.posexplode("values").alias("k", "v"))
    return rows.select("track", (F.col("first") + F.col("k")).alias("idx"), F.col("v").cast("double").alias("v"))
