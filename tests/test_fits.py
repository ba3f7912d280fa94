"""Analytic expectations of the time-map fits."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.config import AnchorSelection, DriftModel, OffsetSafety
from chronoweft.operators import activity, drift, nonlinear, series, timeline
from chronoweft.plans import alignment
from chronoweft.sources import synthetic

KIND = "track string, match_id int, local_start double, local_end double, master_start double, master_end double, confidence double"


def matches(spark, f, times, name="t"):
    return spark.createDataFrame([(name, i, float(x), x + 1.0, float(f(x)), f(x) + 1.0, 1.0) for i, x in enumerate(times)], KIND)


def fitted(spark, f, times, cfg, total=600.0):
    models, judged = drift.fit_linear(matches(spark, f, times))
    durations = spark.createDataFrame([("t", total)], "track string, total double")
    return nonlinear.select_models(models, judged, cfg, durations).first(), models.first(), judged


def bend(*parts):
    def f(x):
        y, at, rate = 1.0, 0.0, parts[0]
        for start, r in parts[1]:
            y, at, rate = y + rate * (min(x, start) - at) if x > at else y, min(x, start), r if x > start else rate
        return y + rate * (x - at)

    return f


def test_constant(spark):
    models, judged = drift.fit_linear(matches(spark, lambda x: 0.75 + 1.0002 * x, range(0, 601, 60)))
    m = models.first()
    assert m.anchor_count == 11 and abs(m.stretch_ratio - 1.0002) < 1e-12 and m.residual_max_ms < 1e-6
    durations = spark.createDataFrame([("t", 600.0)], "track string, total double")
    d = drift.diagnostics(models, judged, durations)
    assert d.first().span_ratio == 1.0 and drift.fit_warnings(d, drift.unsupported(judged, None)).count() == 0


def test_outlier_and_weak_span(spark):
    models, judged = drift.fit_linear(matches(spark, lambda x: 321 if x == 300 else x + 1, range(0, 501, 100)))
    assert models.first().anchor_count == 5
    bad = judged.where("local_start = 300").first()
    assert bad.rejected_reason == "residual_outlier" and bad.residual_ms > 10_000 and not bad.included_in_regression
    models, judged = drift.fit_linear(matches(spark, lambda x: x + 1, range(0, 91, 10)))
    d = drift.diagnostics(models, judged, spark.createDataFrame([("t", 600.0)], "track string, total double"))
    assert d.first().span_seconds == 90 and [r.code for r in drift.fit_warnings(d, drift.unsupported(judged, 90.0)).collect()] == ["VERY_WEAK_DRIFT_ANCHOR_SPAN"]


def test_too_few_and_same_times(spark):
    models, judged = drift.fit_linear(matches(spark, lambda x: x, [5]))
    assert models.count() == 0 and judged.first().residual_ms is None
    m = drift.fit_linear(matches(spark, lambda x: x + 1, [5, 5, 5]))[0].first()
    assert abs(m.stretch_ratio * 5 + m.offset_seconds - 6) < 1e-9


def test_gaps(spark):
    rows = [("t", 0, 0.0, 1.0, 1.0, 2.0, 1.0), ("t", 1, 30.0, 31.0, 31.0, 32.0, 1.0), ("t", 2, 60.0, 61.0, 61.0, 62.0, 1.0), ("t", 3, 240.0, 241.0, 241.0, 242.0, 1.0)]
    g = series.anchor_gaps(spark.createDataFrame(rows, KIND), 90.0).collect()
    assert [(r.local_start, r.local_end, r.master_start, r.master_end, r.local_gap_seconds) for r in g] == [(61.0, 240.0, 62.0, 241.0, 179.0)]


def test_piecewise(spark):
    cfg = DriftModel(drift_model="piecewise_linear", allow_nonlinear_drift=True, min_residual_improvement_ms=0.1)
    m, _, _ = fitted(spark, bend(1.00005, [(300, 1.00035)]), range(0, 601, 60), cfg)
    p = json.loads(m.parameters)
    assert m.model_type == "piecewise_linear" and abs(p["breakpoints"][0] - 300) < 35 and abs(p["slope"] - 1.00005) < 5e-5
    m, _, _ = fitted(spark, bend(1.0, [(300, 1.01)]), range(0, 601, 60), cfg)
    assert m.model_type == "linear"


def test_spline_and_noise(spark):
    auto = DriftModel(allow_nonlinear_drift=True)
    spline = DriftModel(drift_model="spline", allow_nonlinear_drift=True, spline_knot_source="anchors")
    sway = lambda x: 1 + x + 0.05 * math.sin(2 * math.pi * x / 600)
    m, linear, _ = fitted(spark, sway, range(0, 601, 60), DriftModel(drift_model="spline", allow_nonlinear_drift=True, spline_knot_source="anchors", max_rate_change_ppm=1000.0))
    assert m.model_type == "spline" and m.residual_median_ms < 1e-6 and linear.residual_median_ms > 10
    noise = [0, 12, -9, 15, -11, 8, -14, 10, -7, 9, -6]
    m, _, _ = fitted(spark, lambda x: 1 + 1.0001 * x + noise[x // 60] / 1000, range(0, 601, 60), auto)
    assert m.model_type == "linear" and "improvement" in m.fallback_reason
    m, _, _ = fitted(spark, lambda x: x, [0, 120, 240, 360, 480], DriftModel(drift_model="piecewise_linear", allow_nonlinear_drift=True))
    assert m.model_type == "linear" and "min_anchors_for_piecewise" in m.fallback_reason
    m, _, _ = fitted(spark, lambda x: {30: 19}.get(x, x), [0, 10, 20, 30, 40, 50], spline, 50.0)
    assert m.model_type == "linear"


def test_kalman_explicit_only(spark):
    sway = lambda x: 1.25 + x + 0.04 * math.sin(2 * math.pi * x / 600)
    cfg = DriftModel(drift_model="kalman", allow_nonlinear_drift=True, kalman_observation_noise_ms=2.0, kalman_process_offset_noise_ms=20.0, kalman_process_rate_noise_ppm=500.0, max_rate_change_ppm=1000.0)
    m, _, _ = fitted(spark, sway, range(0, 601, 60), cfg)
    p = json.loads(m.parameters)
    assert m.model_type == "kalman" and len(p["offset_std_ms"]) == 11
    assert abs(np.interp(150.0, p["knot_local"], p["knot_master"]) - sway(150)) < 0.010
    assert [r.start for r in m.pieces] == p["knot_local"][:-1]


def test_activity(spark):
    v = [0.01] * 8000 + [0.08] * 16000 + [0.01] * 8000
    s = spark.createDataFrame([("t", i, x) for i, x in enumerate(v)], "track string, idx long, v double")
    (seg,) = activity.detect(s, 16000, "adaptive_rms").collect()
    assert seg.start <= 0.6 and seg.end >= 1.4 and seg.confidence > 0.2
    flat = s.where("idx < 16000").withColumn("v", s.v * 0 + 0.015)
    assert activity.detect(flat, 16000, "rms", threshold=0.01).count() == 1 and activity.detect(flat, 16000, "rms").count() == 0
    with pytest.raises(RuntimeError):
        activity.detect(s, 16000, "webrtc")
    with pytest.raises(ValueError):
        activity.detect(s, 16000, "no such")


def test_inverse_and_jumps(spark):
    f = lambda t: 0.25 + (t if t <= 0.5 else 0.5 + 1.5 * (t - 0.5))
    table = spark.createDataFrame([("t", k, k / 1000, f(k / 1000)) for k in range(1001)], "track string, k int, local_t double, master_t double")
    points = spark.createDataFrame([("t", i, x) for i, x in enumerate((0.25, 0.5, 0.75, 1.25, 0.1))], "track string, i int, master_t double")
    got = {r.i: r.local_t for r in timeline.inverse(points, table, None, ["track", "i"]).collect()}
    assert all(abs(got[i] - w) < 1e-3 for i, w in enumerate((0, 0.25, 0.5, 5 / 6))) and got[4] is None
    d = F.lit
    torn = timeline.jump(lambda t: t + F.when(t > 0.5, 0.5).otherwise(0.0), (d(0.499), d(0.501)), (d(0.499), d(1.001)), d(0.01))
    steep = timeline.jump(lambda t: 1 / (1 + F.exp((t - 0.5) * -400.0)), (d(0.45), d(0.55)), (d(0.0), d(1.0)), d(0.01))
    r = spark.range(1).select(torn.alias("torn"), steep.alias("steep")).first()
    assert abs(r.torn.gap_start - 0.5) < 1e-6 and abs(r.torn.gap_end - 1.0) < 1e-6 and r.steep is None


def test_alignment_end_to_end(spark):
    local = synthetic.program(spark, 500)
    ref = synthetic.heard(local, lambda t: synthetic.constant(t, 0.75, 1.0), 500, 27.0)
    a = alignment.align(local.selectExpr("'x' AS track", "idx", "v"), ref, alignment.Options(sample_rate=500, selection=AnchorSelection(min_anchor_count=8)))
    m = a.models.first()
    assert abs(m.offset_seconds - 0.75) < 1e-6 and abs(m.stretch_ratio - 1) < 1e-9 and m.anchor_count == 8
    heard = {r.idx: r.v for r in ref.collect()}
    made = a.rendered.collect()
    assert len(made) == 13_500 and max(abs(r.v - heard[r.i]) for r in made) < 1e-6
    a.release()


def test_options_are_validated():
    for bad in (lambda: OffsetSafety(low_confidence_threshold=0.6), lambda: DriftModel(drift_model="kalman"), lambda: AnchorSelection(min_anchor_duration_seconds=9.0), lambda: DriftModel(drift_model="x")):
        with pytest.raises(ValueError):
            bad()
    assert DriftModel().as_dict()["selection_policy"] == "linear_default"
