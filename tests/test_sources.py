"""Recordings by blocks, files by executors, messages by language."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.functions.signal import resample
from chronoweft.operators import report
from chronoweft.sources import locales, sinks, wav


def aiff(x, rate, code=b""):
    """A stereo 16-bit file, both channels alike."""
    body = np.repeat(np.rint(x * 32767).astype("<i2" if code == b"sowt" else ">i2"), 2).tobytes()
    e = 16383 + int(np.log2(rate))
    mantissa = int(rate * 2 ** (63 - int(np.log2(rate))))
    comm = struct.pack(">hIh", 2, len(x), 16) + struct.pack(">HQ", e, mantissa) + (code + b"\0\0" if code else b"")
    chunk = lambda n, b: n + struct.pack(">I", len(b)) + b + b"\0" * (len(b) % 2)
    inner = (b"AIFC" if code else b"AIFF") + chunk(b"NAME", b"a" * 9001) + chunk(b"COMM", comm) + chunk(b"SSND", struct.pack(">II", 0, 0) + body)
    return b"FORM" + struct.pack(">I", len(inner)) + inner


def test_files_are_read_in_blocks(spark, tmp_path):
    x = np.sin(np.arange(5000) / 7) * 0.5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "in" / "b.AIFF").write_bytes(aiff(x, 44100))
    (tmp_path / "in" / "c.aif").write_bytes(aiff(x, 8000, b"sowt"))
    (tmp_path / "in" / "notes.txt").write_text("no")
    h = {r.track: (r.sample_rate, r.channels, r.frames) for r in wav.read_headers(spark, str(tmp_path / "in")).collect()}
    assert h == {"a": (8000, 1, 5000), "b": (44100, 2, 5000), "c": (8000, 2, 5000)}
    rows = wav.read_series(spark, str(tmp_path / "in"), chunk=700)
    assert rows.groupBy("track").count().first()["count"] == 8
    for r in wav.samples_of(rows).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s")).collect():
        assert [s.idx for s in r.s] == list(range(5000)) and np.abs(np.array([s.v for s in r.s]) - x).max() < 1e-4
    low = wav.samples_of(wav.read_series(spark, str(tmp_path / "in"), 4000, chunk=700)).where("track = 'a'").orderBy("idx").collect()
    want = resample(np.rint(x * 32767) / 32768, 8000, 4000)
    assert [r.idx for r in low] == list(range(len(want))) and np.abs(np.array([r.v for r in low]) - want).max() < 1e-5


def test_bad_files_are_errors(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(wav.encode(np.zeros(900), 8000)[:-50])
    with pytest.raises(Exception, match="fewer"):
        wav.read_series(spark, str(tmp_path)).collect()
    with pytest.raises(wav.SeriesError):
        wav.header(b"FORM0000JUNKxxxx")
    with pytest.raises(wav.SeriesError):
        wav.header(aiff(np.zeros(9), 8000, b"ima4"))


def test_files_are_written_where_the_rows_are(spark, tmp_path):
    rows = [("one", i, 0.25) for i in range(300) if i not in (10, 11, 299)] + [("one", 299, 1.0), ("two", 4, -0.5)]
    df = spark.createDataFrame(rows, "track string, idx long, v double").repartition(3)
    done = {r.track: r.frames for r in sinks.write_wavs(df, 8000, str(tmp_path / "out")).collect()}
    assert done == {"one": 300, "two": 5}
    one = wav.decode((tmp_path / "out" / "one.wav").read_bytes())[:, 0]
    assert len(one) == 300 and one[10] == one[11] == 0 and abs(one[9] - 0.25) < 1e-4 and one[299] > 0.99
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.wav", "two.wav"]


def test_the_pack_of_cases(spark, tmp_path):
    sinks.write_pack(spark, str(tmp_path), 500, 4.0, 6.0)
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert len(m["cases"]) == 5 and all((tmp_path / c["master"]).exists() and (tmp_path / c["local"]).exists() for c in m["cases"])


def test_messages_by_language(spark, tmp_path):
    assert locales.message("warnings.low_anchor_count", "de") != locales.message("warnings.low_anchor_count") == locales.message("warnings.low_anchor_count", "xx")
    (tmp_path / "en.json").write_text(json.dumps({"warnings.a": "A {n} {m:.2f}", "odd": "B"}))
    (tmp_path / "fr.json").write_text(json.dumps({"warnings.a": "A {m}"}))
    c = locales.catalog(spark, str(tmp_path))
    assert {(r.locale, r.key) for r in c.collect()} == {("en", "warnings.a"), ("en", "odd"), ("fr", "warnings.a")}
    assert {r.locale for r in locales.catalog(spark, str(tmp_path), "it").collect()} == {"en"}
    assert {(r.locale, r.key, r.problem) for r in report.locale_errors(c).collect()} == {("fr", "odd", "missing"), ("fr", "warnings.a", "placeholders"), ("en", "odd", "prefix")}
