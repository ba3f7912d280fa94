"""Every track through its own map, whatever its kind, and the alignment that ends in it."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.config import AnchorSelection, DriftModel, OffsetSafety
from chronoweft.operators import correlate, nonlinear, render, stretch
from chronoweft.plans import alignment
from chronoweft.plans.progress import Progress
from chronoweft.sources import sinks, synthetic
from chronoweft.sources.staging import staged

PIECE = "array<struct<start:double,a:double,b:double,c:double,d:double>>"
RATE = 100


def models(spark, maps):
    rows = [(n, m.kind, [tuple(p) for p in m.pieces.tolist()]) for n, m in maps.items()]
    return spark.createDataFrame(rows, f"track string, model_type string, pieces {PIECE}")


def maps():
    x = np.array([0.0, 3.0, 6.0, 10.0])
    bend = nonlinear.hinged(0.5, 1.0, [5.0], [0.2], 9)
    spline = nonlinear.through("spline", x, x + 1 + 0.2 * np.sin(x), 9, {})
    states = nonlinear.through("kalman", x, x * 1.01 + 0.25, 9, {})
    return {"line": nonlinear.line(1.1, -1.0, 9, 0, 0), "bend": bend, "spline": spline, "kalman": states, "down": nonlinear.line(-1.0, 3.0, 9, 0, 0)}


@pytest.fixture(scope="module")
def series_of(spark):
    v = {n: np.sin(np.arange(1000) / (7 + i)) for i, n in enumerate(maps())}
    rows = [(n, i, float(x)) for n, s in v.items() for i, x in enumerate(s)]
    tracks = [(n, 10.0, 12.0) for n in v] + [("void", 0.0, 12.0)]
    both = models(spark, maps() | {"void": nonlinear.line(1.0, 0.0, 0, 0, 0)})
    return v, staged(spark.createDataFrame(rows, "track string, idx long, v double")), both, spark.createDataFrame(tracks, "track string, total double, master_total double")


def inverted(m, s):
    """The series at the grid of the reference, by brute force."""
    t = np.linspace(0, 10, 200_001)
    at = np.interp(np.arange(1200) / RATE, m(t), t, left=np.nan, right=np.nan) * RATE
    ok = np.isfinite(at) & (at <= len(s) - 1 + 1e-9)
    return np.where(ok, np.interp(np.where(ok, at, 0), np.arange(len(s)), s), 0.0)


@pytest.mark.parametrize("method", ["resample", "time_map"])
def test_each_kind_of_map(spark, series_of, method):
    v, samples, selected, tracks = series_of
    made = render.render(samples, selected, tracks, RATE, method, stage=staged)
    got = {}
    for r in made.samples.collect():
        got.setdefault(r.track, np.full(1200, np.nan))[r.i] = r.v
    assert set(got) == {*v, "void"} and not any(np.isnan(g).any() for g in got.values())
    for n, m in maps().items():
        if n == "down":
            continue
        want = inverted(m, v[n])
        off = np.abs(got[n] - want)
        # at either end a sample may fall on the other side of the support; whole samples of a time map are off by half of one
        assert np.median(off) < (1e-4 if method == "resample" else 0.12) and (off > (1e-3 if method == "resample" else 0.3)).sum() <= 6, n
    assert not got["void"].any() and not got["down"].any()
    info = {r.track: r for r in made.info.collect()}
    curve = "timemap_time_map" if method == "time_map" else "inverse_time_map"
    assert {n: r.render_method for n, r in info.items()} == {"line": "linear_resample", "down": "linear_resample", "bend": curve, "spline": curve, "kalman": curve, "void": "silence_empty_source"}
    assert info["line"].stretch_ratio == 1.1 and info["spline"].stretch_ratio is None and not info["down"].rising and info["bend"].rising
    regions = {(r.track, r.reason) for r in made.regions.collect()}
    assert ("void", "empty_source_track") in regions and ("down", "outside_drift_model_support") in regions and ("bend", "before_drift_model_support") in regions
    assert not any(reason == "internal_drift_model_gap" for _, reason in regions)


def test_methods_that_follow_no_map_are_refused(spark, series_of):
    _, samples, selected, tracks = series_of
    stretch.register_method("own", stretch.by_interpolation)
    with pytest.raises(ValueError):
        render.render(samples, selected, tracks, RATE, "own")
    line = render.render(samples, selected.where("track = 'line'"), tracks, RATE, "own")
    assert line.info.first().render_method == "linear_own" and line.samples.count() == 1200
    with pytest.raises(ValueError):
        render.render(samples, selected, tracks, RATE, "unheard_of")
    with pytest.raises(RuntimeError):
        render.render(samples, selected, tracks, RATE, "rubberband")


def test_pieces_are_the_maps(spark):
    at = np.linspace(-1, 12, 80)
    rows = [(n, float(t)) for n in maps() for t in at]
    df = models(spark, maps()).join(spark.createDataFrame(rows, "track string, t double"), "track")
    got = {(r.track, r.t): (r.v, r.r) for r in df.select("track", "t", nonlinear.value(F.col("pieces"), F.col("t")).alias("v"), nonlinear.rate(F.col("pieces"), F.col("t")).alias("r")).collect()}
    for n, m in maps().items():
        for t, v, r in zip(at, *m.at(at)):
            assert np.allclose(got[n, float(t)], (v, r), atol=1e-9)


def test_breakpoints_are_those_of_whole_fits():
    r = np.random.default_rng(3)
    cfg = DriftModel(drift_model="piecewise_linear", allow_nonlinear_drift=True)
    for _ in range(4):
        x = np.sort(r.uniform(0, 900, 40))
        y = 1 + x * 1.0001 + np.maximum(0, x - 400) * 4e-4 + r.normal(0, 0.002, 40)
        w = r.uniform(0.2, 1, 40)
        tried = np.unique(np.concatenate((x[3:-3], (x[3:-3] + x[4:-2]) / 2)))
        want = [nonlinear.piecewise_fit(x, y, w, sorted([200.0, b])).residual_median_ms for b in tried]
        assert np.allclose(nonlinear._median_with(x, y, w, [200.0], tried), want, rtol=0, atol=1e-4)
        found = nonlinear.search_breakpoints(x, y, w, 1e9, cfg)
        assert found and abs(found[0] - 400) < 120 or len(found) > 1


@pytest.mark.parametrize("case,cfg,kind", [
    ("piecewise-drift", {"drift_model": "piecewise_linear", "min_anchors_for_piecewise": 6, "min_residual_improvement_ms": 0.1, "max_rate_change_ppm": 9000.0, "max_abs_rate_deviation_ppm": 9000.0}, "piecewise_linear"),
    ("known-offset", {"drift_model": "auto"}, "linear"),
])
def test_alignment_renders_the_selected_map(spark, tmp_path, case, cfg, kind):
    local = synthetic.program(spark, 500)
    mapping, _ = synthetic.CASES[case]
    ref = synthetic.heard(local, mapping, 500, 27.0)
    seen = []
    o = alignment.Options(sample_rate=500, selection=AnchorSelection(min_anchor_count=14, max_anchor_density_per_minute=60.0, anchor_density_per_minute=40.0), drift=DriftModel(allow_nonlinear_drift=True, **cfg), accept_stretch=True)
    a = alignment.align(local.selectExpr("'x' AS track", "idx", "v"), ref, o, progress=lambda *x: seen.append(x))
    m = a.selected.first()
    assert m.model_type in (kind, "linear")
    assert a.render_info.first().render_method == ("linear_resample" if m.model_type == "linear" else "inverse_time_map")
    assert a.rendered.count() == 13_500 and [s[0] for s in seen][-1] == 100.0
    doc = a.document
    sinks.write_report(doc, str(tmp_path / "sync-report.json"))
    report = json.loads((tmp_path / "sync-report.json").read_text())
    (track,) = report["tracks"]
    assert report["report_type"] == "alignment_diagnostics" and track["name"] == "x" and track["model_type"] == m.model_type and track["drift_anchor_match_summary"]["count"] == a.matches.count()
    assert [w["code"] for w in track["warnings"]] == [w["code"] for w in report["warnings"]]
    with pytest.raises(ValueError):
        sinks.write_markers(None, str(tmp_path / "m"), a.reports)
    sinks.write_markers(a.matches, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns[0] == "track"
    a.release()


def test_a_quiet_reference_and_policies(spark):
    local = synthetic.program(spark, 500).selectExpr("'x' AS track", "idx", "v")
    ref = synthetic.heard(synthetic.program(spark, 500), lambda t: synthetic.constant(t, 0.75, 1.0), 500, 27.0).withColumn("v", F.col("v") * 0.0)
    for policy, reason in (("reject", "master_vad_unavailable"), ("warn", None)):
        a = alignment.align(local, ref, alignment.Options(sample_rate=500, selection=AnchorSelection(min_anchor_count=4), safety=OffsetSafety(master_vad_uncertain_policy=policy)))
        assert {r.rejected_reason for r in a.matches.collect()} <= {reason, "ncc_best_score_below_min"} and {"MASTER_VAD_NO_SPEECH_SEGMENTS", "ALIGNMENT_FAILED"} <= {r.code for r in a.issues.collect()}
        a.release()


def test_further_peaks_are_tried():
    x = np.zeros(500)
    x[[50, 200, 350]] = 0.9, 0.8, 0.7
    found = correlate.successive_peaks(x, 5, 5, 0.75)
    assert [p["best_lag"] for p in found] == [50, 200]
    assert [p["best_lag"] for p in correlate.successive_peaks(x * 0, 5, 5, 0.1)] == [0]
    assert correlate.successive_peaks(np.empty(0), 5, 5, 0.1) == []


def test_match_takes_the_peak_where_the_reference_is_active(spark):
    from chronoweft.config import AnchorMatching

    r = np.random.default_rng(2)
    clip = r.standard_normal(100)
    search = 0.01 * r.standard_normal(2000)
    search[300:400], search[1500:1600] = clip, 0.9 * clip + 0.2 * r.standard_normal(100)
    pairs = spark.createDataFrame([("t", 1, 5.0, 6.0, 1.0, clip.tolist(), search.tolist(), 0)], "track string, segment_id long, local_start double, local_end double, anchor_confidence double, clip array<double>, search array<double>, search_first long")
    at = lambda spans: correlate.match(pairs, 100, AnchorMatching(), ["track", "segment_id"], spark.createDataFrame(spans, "start double, end double"), OffsetSafety()).first()
    assert at([(0.0, 20.0)]).master_start == 3.0 and at([(14.0, 17.0)]).master_start == 15.0
    off = at([(8.0, 9.0)])
    assert (off.master_start, off.confidence, off.rejected_reason) == (3.0, 0.0, "master_vad_no_overlap")
    assert correlate.match(pairs, 100, AnchorMatching(), ["track", "segment_id"]).first().master_start == 3.0


def test_progress_and_time_left():
    now, lines = [0.0], []
    p = Progress(4, event=lines.append, clock=lambda: now[0])
    now[0] = 2.0
    assert p.step("a") == (25.0, 6.0)
    now[0] = 3.0
    assert p.step("b", 3) == (100.0, 0.0) and p.step("c") == (100.0, 0.0) and len(lines) == 3 and math.isclose(p.done, 4)


def test_chunks_are_resampled_where_they_lie(spark):
    from chronoweft.functions.signal import resample

    r = np.random.default_rng(5)
    for source, target in ((800, 300), (500, 500), (300, 700)):
        x = {n: r.standard_normal(k) for n, k in (("a", 1000), ("b", 257))}
        rows = spark.createDataFrame([(n, i, float(v)) for n, s in x.items() for i, v in enumerate(s)], "track string, idx long, v double")
        made = {}
        for row in correlate.resampled(correlate.chunked(rows, 128), 128, source, target).collect():
            made.setdefault(row.track, {}).update({row.first + k: v for k, v in enumerate(row["values"])})
        for n, s in x.items():
            want = resample(s, source, target)
            assert sorted(made[n]) == list(range(len(want))) and np.allclose([made[n][i] for i in range(len(want))], want, atol=1e-9)


def test_coarse_offset_of_whole_recordings(spark):
    r = np.random.default_rng(6)
    rate, low = 800, 200
    ref = np.cumsum(r.standard_normal(16_000)) * 0.01
    far = spark.createDataFrame([("ref", i, float(v)) for i, v in enumerate(ref)], "track string, idx long, v double")
    near = spark.createDataFrame([(n, i, float(v)) for n, at in (("x", 2400), ("y", 4800)) for i, v in enumerate(ref[at : at + 6400])], "track string, idx long, v double")
    asked = spark.createDataFrame([("x", 8.0, 20.0), ("y", 8.0, 20.0)], "track string, local_seconds double, master_seconds double")
    got = {c.track: c for c in alignment._coarse(asked, correlate.chunked(near, alignment.CHUNK), correlate.chunked(far, alignment.CHUNK), rate, low, staged).collect()}
    assert abs(got["x"].offset_seconds - 3.0) < 0.01 and abs(got["y"].offset_seconds - 6.0) < 0.01 and got["x"].confidence > 0.9
