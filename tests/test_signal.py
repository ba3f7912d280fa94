import numpy as np
import pytest

from chronoweft.functions import signal as M
from chronoweft.sources import wav


def test_ncc_is_the_direct_sum():
    r = np.random.default_rng(42)
    for n, m in ((60, 9), (3000, 400)):
        s, f = r.standard_normal(n), r.standard_normal(m)
        c = f - f.mean()
        want = [(lambda w: (w - w.mean()) @ c / np.linalg.norm(w - w.mean()) / np.linalg.norm(c))(s[i : i + m]) for i in range(n - m + 1)]
        assert np.allclose(M.ncc(s, f), want, atol=1e-9)
    assert (M.ncc(np.ones(9), np.arange(3.0)) == -1).all() and (M.ncc(np.arange(9.0), np.ones(3)) == -1).all()
    assert M.ncc(np.arange(3.0), np.arange(4.0)).size == 0


def test_inserted_feature_is_found():
    r = np.random.default_rng(42)
    s, f = r.standard_normal(1000) * 0.1, r.standard_normal(50)
    s[200:250] = f
    assert M.ncc(s, f).argmax() == 200 and M.ncc(s, f).max() > 0.999
    s = r.standard_normal(8000) * 0.1
    f = r.standard_normal(400) * 0.1
    s[3000:3400] += f
    g = M.gcc_phat(s, f)
    assert abs(int(g.argmax()) - 3000) <= 3 and g.max() > 0.05


@pytest.mark.parametrize("scores,exclusion,best,second", [
    ([0.1, 0.2, 0.15, 0.9, 0.16, 0.12, 0.11], 16, 3, None), ([0.1, 0.2, 0.15, 1, 0.16, 0.12, 1, 0.11], 16, 3, None), ([0.1, 0.2, 0.15, 1, 0.16, 0.12, 1, 0.11], 1, 3, 6), ([0.0] * 4, 800, 0, None),
])
def test_peaks(scores, exclusion, best, second):
    p = M.peak_report(np.array(scores, float), exclusion)
    assert p["best_lag"] == best and p["second_lag"] == second


def test_peak_figures():
    x = np.zeros(200)
    x[50], x[100] = 1, 0.8
    p = M.peak_report(x, 16)
    assert (p["best_lag"], p["second_score"], round(p["margin"], 9), p["prominence"], p["width_samples"]) == (50, 0.8, 0.2, 1.0, 1.0)
    assert M.peak_report(np.array([]), 1) is None
    assert list(M.local_maxima(np.array([0, 2, 2, 2, 1, 3, 3.0]))) == [2]


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = M.resample(np.sin(2 * np.pi * 440 * t), 8000, 16000)
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y - want)[200:-200].max() < 2e-3
    assert len(M.resample(np.ones(1001), 16000, 8000)) == 501
    with pytest.raises(ValueError):
        M.resample(np.ones(3), 0, 1)


def test_pchip_is_monotone_and_exact_on_knots():
    x, y = np.array([0, 1, 2.5, 3, 7.0]), np.array([0, 0.1, 3, 3.2, 9.0])
    at = np.linspace(0, 7, 500)
    v, d = M.pchip(x, y, at)
    assert (np.diff(v) > 0).all() and (d >= -1e-12).all() and np.allclose(M.pchip(x, y, x)[0], y)
    assert np.allclose(M.pchip(x[:2], y[:2], at)[0], 0.1 * at)


def test_flatness():
    r = np.random.default_rng(1)
    assert M.flatness(np.sin(np.arange(1000) * 0.3)) < 0.05 < 0.4 < M.flatness(r.standard_normal(1000)) <= 1
    assert M.flatness(np.ones(9)) == 1.0 == M.flatness(np.array([]))


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(1000) / 7) * 0.5
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "note.txt").write_text("no")
    h = wav.read_headers(spark, str(tmp_path)).collect()
    assert [(r.track, r.sample_rate, r.channels, r.frames, r.duration_seconds) for r in h] == [("a", 8000, 1, 1000, 0.125)]
    got = wav.samples_of(wav.read_series(spark, str(tmp_path), chunk=300)).orderBy("idx").collect()
    assert len(got) == 1000 and np.abs(np.array([r.v for r in got]) - x).max() < 1e-4
    with pytest.raises(wav.SeriesError):
        wav.header(b"RIFF0000WAVE")
    with pytest.raises(wav.SeriesError):
        wav.decode(wav.encode(x, 8000)[:-10])


def test_sinks(spark, tmp_path):
    from chronoweft.sources import sinks

    rows = spark.createDataFrame([("t", i, 0.5 if i % 2 else -2.0) for i in range(20)], "track string, idx long, v double")
    sinks.write_wavs(rows, 8000, str(tmp_path / "out"))
    back = wav.decode((tmp_path / "out" / "t.wav").read_bytes())[:, 0]
    assert np.abs(back - np.array([0.5 if i % 2 else -1.0 for i in range(20)])).max() < 1e-4
    issues = spark.createDataFrame([("t", 1, None, "warning", "A", "msg"), ("t", 0, 1.5, "error", "B", "m2")], "track string, seq int, time_seconds double, severity string, code string, message string")
    sinks.write_warnings(issues, str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["[ERROR] track=t time=1.500s code=B msg=m2", "[WARNING] track=t time=n/a code=A msg=msg"]
