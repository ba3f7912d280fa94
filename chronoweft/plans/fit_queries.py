"""Queries: linear fits, their diagnostics, piecewise and smoothed maps, model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DriftModel
from ..functions import scalar as S
from ..operators import drift, nonlinear
from ..sources.tables import OBSERVATIONS_SQL, USER_SERIES_SQL, observations, user_series
from .activity_queries import M
from .registry import query


def milli(c):
    return F.floor(F.col(c) * 1e3 + 0.5) / 1e3


K = "floor(({}) * 1e3 + 0.5) / 1e3".format


def _line_sql(source: str, out: str) -> str:
    return f"""{out}m AS (SELECT track, sum(w * local_start) / sum(w) AS mx, sum(w * master_start) / sum(w) AS my FROM {source} GROUP BY track),
{out}s AS (SELECT track, mx, my, count(*) AS n, sum(w * (local_start - mx) * (local_start - mx)) AS sxx, sum(w * (local_start - mx) * (master_start - my)) AS sxy, max(abs(local_start - mx)) AS reach FROM {source} JOIN {out}m USING (track) GROUP BY ALL),
{out} AS (SELECT track, n, CASE WHEN reach <= 1e-12 * greatest(1, abs(mx)) THEN mx * my / (mx * mx + 1) ELSE sxy / sxx END AS slope, my, mx FROM {out}s)"""


def _round_sql(source: str, n: int) -> str:
    return f"""{_line_sql(source, f'l{n}')},
d{n} AS (SELECT k.*, (master_start - (slope * local_start + my - slope * mx)) * 1000 AS r FROM {source} k JOIN l{n} USING (track)), m{n} AS (SELECT track, median(r) AS mid, median(abs(r)) AS size FROM d{n} GROUP BY track),
a{n} AS (SELECT track, greatest(40, 3.5 * median(abs(r - mid)), 2.5 * any_value(size)) AS th FROM d{n} JOIN m{n} USING (track) GROUP BY track),
j{n} AS (SELECT d{n}.*, th, abs(r) <= th AS ok, count(*) FILTER (abs(r) <= th) OVER (PARTITION BY track) AS lft FROM d{n} JOIN a{n} USING (track)),
k{n} AS (SELECT track, match_id, local_start, master_start, w FROM j{n} WHERE ok OR lft < 2)"""


_FIT = f"""WITH {OBSERVATIONS_SQL}, e0 AS (SELECT *, greatest(confidence, 1e-3) AS w, count(*) OVER (PARTITION BY track) AS eligible FROM m WHERE confidence >= 0.05),
k0 AS (SELECT track, match_id, local_start, master_start, w FROM e0 WHERE eligible >= 2), {_round_sql('k0', 1)}, {_round_sql('k1', 2)}, {_line_sql('k2', 'fin')},
model AS (SELECT track, slope, my - slope * mx AS icept, n, mx FROM fin),
judged AS (SELECT m.*, k2.match_id IS NOT NULL AS included, (m.master_start - (slope * m.local_start + icept)) * 1000 AS r, CASE WHEN confidence < 0.05 THEN 'excluded_by_min_confidence' WHEN k2.match_id IS NULL AND slope IS NOT NULL THEN 'residual_outlier' END AS reason
 FROM m LEFT JOIN model USING (track) LEFT JOIN k2 ON k2.track = m.track AND k2.match_id = m.match_id)"""


@query(f"WITH {OBSERVATIONS_SQL}, k AS (SELECT *, greatest(confidence, 1e-3) AS w FROM m), {_line_sql('k', 'fin')} SELECT track, n, {M('slope')} AS slope, {M('my - slope * mx')} AS intercept FROM fin")
def wls_linear(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("w", F.greatest("confidence", F.lit(1e-3)))
    return drift.weighted_line(o, "local_start", "master_start", "w").select("track", "n", S.micro("slope").alias("slope"), S.micro("intercept").alias("intercept"))


def _fit(spark, sf_dir):
    return drift.fit_linear(observations(spark, sf_dir))


@query(f"""{_FIT}, rs AS (SELECT track, median(abs(r)) AS mid, max(abs(r)) AS top FROM judged WHERE included GROUP BY track), el AS (SELECT track, count(*) AS eligible FROM e0 GROUP BY track), th AS (SELECT track, any_value(th) AS th FROM j2 GROUP BY track)
SELECT track, {M('slope')} AS stretch_ratio, {K('icept')} AS offset_seconds, n AS anchor_count, eligible AS eligible_count, {K('mid')} AS residual_median_ms, {K('top')} AS residual_max_ms, {K('th')} AS threshold_ms FROM model JOIN rs USING (track) JOIN el USING (track) JOIN th USING (track)""")
def wls_two_round(spark, sf_dir):
    models, _ = _fit(spark, sf_dir)
    return models.select("track", S.micro("stretch_ratio").alias("stretch_ratio"), milli("offset_seconds").alias("offset_seconds"), "anchor_count", "eligible_count", *(milli(c).alias(c) for c in ("residual_median_ms", "residual_max_ms", "threshold_ms")))


@query(f"{_FIT} SELECT track, match_id, included AS included_in_regression, reason AS rejected_reason, {K('r')} AS residual_ms FROM judged")
def judged_matches(spark, sf_dir):
    _, judged = _fit(spark, sf_dir)
    return judged.select("track", "match_id", "included_in_regression", "rejected_reason", milli("residual_ms").alias("residual_ms"))


@query(f"""{_FIT} SELECT track, count(*) AS match_count, count(*) FILTER (included) AS included_count, count(*) FILTER (NOT included) AS rejected_count, {K('min(r) FILTER (included)')} AS residual_min_ms, {K('median(r) FILTER (included)')} AS residual_median_ms, {K('max(r) FILTER (included)')} AS residual_max_ms FROM judged GROUP BY track""")
def residual_summary(spark, sf_dir):
    out = drift.summary(_fit(spark, sf_dir)[1])
    return out.select("track", "match_count", "included_count", "rejected_count", *(milli(c).alias(c) for c in ("residual_min_ms", "residual_median_ms", "residual_max_ms")))


def _durations(judged):
    return judged.groupBy("track").agg((F.max("local_start") + 100.0).alias("total"))


@query(f"""{_FIT}, t AS (SELECT track, max(local_start) + 100.0::DOUBLE AS total, count(*) AS n FROM judged GROUP BY track), sp AS (SELECT track, count(*) AS fitted, min(local_start) AS a, max(local_start) AS b FROM judged WHERE included GROUP BY track), el AS (SELECT track, count(*) AS eligible FROM e0 GROUP BY track)
SELECT track, t.n AS input_anchor_count, fitted AS fitted_anchor_count, eligible - fitted AS outlier_count, a AS span_start, b AS span_end, b - a AS span_seconds, {M('(b - a) / total')} AS span_ratio FROM model JOIN t USING (track) JOIN sp USING (track) JOIN el USING (track)""")
def fit_diagnostics(spark, sf_dir):
    models, judged = _fit(spark, sf_dir)
    d = drift.diagnostics(models, judged, _durations(judged))
    return d.select("track", "input_anchor_count", "fitted_anchor_count", "outlier_count", "span_start", "span_end", "span_seconds", S.micro("span_ratio").alias("span_ratio"))


_GAPS = f"""{_FIT}, g0 AS (SELECT track, lag(local_end) OVER w AS ls, local_start AS le, lag(master_end) OVER w AS ms, master_start AS me FROM judged WHERE included WINDOW w AS (PARTITION BY track ORDER BY local_start, match_id)),
g AS (SELECT *, le - ls AS lg, me - ms AS mg FROM g0 WHERE le - ls > 0 AND me - ms > 0 AND (le - ls > 25 OR me - ms > 25))"""


@query(f"{_GAPS} SELECT track, ls AS local_start, le AS local_end, {M('ms')} AS master_start, {M('me')} AS master_end, lg AS local_gap_seconds, {M('mg')} AS master_gap_seconds FROM g")
def anchor_gaps(spark, sf_dir):
    g = drift.unsupported(_fit(spark, sf_dir)[1], 25.0)
    return g.select("track", "local_start", "local_end", S.micro("master_start").alias("master_start"), S.micro("master_end").alias("master_end"), "local_gap_seconds", S.micro("master_gap_seconds").alias("master_gap_seconds"))


@query(f"""{_GAPS}, el AS (SELECT track, count(*) AS eligible FROM e0 GROUP BY track), sp AS (SELECT track, count(*) AS fitted FROM judged WHERE included GROUP BY track)
SELECT track, 0 AS seq, 'DRIFT_OUTLIERS_REJECTED' AS code, NULL::DOUBLE AS time_seconds FROM el JOIN sp USING (track) WHERE eligible > fitted UNION ALL SELECT track, 1, 'ANCHOR_GAP_UNSUPPORTED_REGION', {M('ms')} FROM g""")
def fit_warnings(spark, sf_dir):
    models, judged = _fit(spark, sf_dir)
    w = drift.fit_warnings(drift.diagnostics(models, judged, _durations(judged)), drift.unsupported(judged, 25.0))
    return w.withColumn("time_seconds", S.micro("time_seconds"))


@query(f"WITH {OBSERVATIONS_SQL} SELECT track, match_id, {M('1.5 + 1.0001::DOUBLE * local_start + 0.0003::DOUBLE * greatest(0, local_start - 1500) - 0.0005::DOUBLE * greatest(0, local_start - 2200)')} AS master_start FROM m")
def piecewise_predict(spark, sf_dir):
    a = lambda *v: F.array(*(F.lit(x) for x in v))
    made = drift.hinge(F.col("local_start"), F.lit(1.5), F.lit(1.0001), a(1500.0, 2200.0), a(0.0003, -0.0005))
    return observations(spark, sf_dir).select("track", "match_id", S.micro(made).alias("master_start"))


@query(f"""WITH {USER_SERIES_SQL}, d AS (SELECT track, idx, v / 1e6 AS c FROM s WHERE idx >= 1), r AS (SELECT track, idx, 1.0 + sum(c) OVER (PARTITION BY track ORDER BY idx ROWS UNBOUNDED PRECEDING) AS rate FROM d)
SELECT track, idx AS segment, {M('rate')} AS rate FROM r UNION ALL SELECT DISTINCT track, 0, 1.0::DOUBLE FROM d""")
def segment_rates(spark, sf_dir):
    return _rates(user_series(spark, sf_dir).where("idx >= 1"))  # the first event has no change before it


def _rates(s):
    d = s.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("v") / 1e6).alias("c")))).alias("c"))
    rates = d.select("track", F.posexplode(drift.segment_rates(F.lit(1.0), F.transform("c", lambda x: x["c"]))).alias("segment", "rate"))
    return rates.select("track", F.col("segment").cast("long").alias("segment"), S.micro("rate").alias("rate"))


# State estimation -------------------------------------------------------------------

_SO, _SR, _OB, _PO, _PR = 0.05, 0.01, 0.2, 1.0, 0.1


def _filtered(spark, sf_dir):
    """States of each user's series."""
    rows = user_series(spark, sf_dir).select("track", F.col("idx").cast("double").alias("t"), (F.col("v") / 1e4).alias("z"), ((F.col("v") % 10 + 1) / 11.0).alias("confidence"), F.lit(0.25).alias("first_offset"), F.lit(0.001).alias("first_rate"))
    return drift.kalman_forward(rows, _SO, _SR, _OB, _PO, _PR)


def _states(df):
    return df.select("track", F.col("n").cast("long").alias("n"), *(S.micro(c).alias(c) for c in ("offset", "rate", "p00", "p01", "p11")))


def _uncertainty(df):
    sd = F.sqrt(F.greatest("p00", F.lit(0.0))) * 1e3
    return df.groupBy("track").agg(S.micro(F.median(sd)).alias("median_offset_std_ms"), S.micro(F.max(sd)).alias("max_offset_std_ms"))


_KALMAN = f"""WITH RECURSIVE {USER_SERIES_SQL}, ob AS (SELECT track, CAST(idx AS BIGINT) AS n, v / 1e4 AS z, ({_OB}::DOUBLE / ((v % 10 + 1) / 11.0::DOUBLE)) ** 2 AS noise FROM s),
kf AS (SELECT track, n, 0.25::DOUBLE AS po, 0.001::DOUBLE AS pr, ({_PO}::DOUBLE) ** 2 AS q00, 0.0::DOUBLE AS q01, ({_PR}::DOUBLE) ** 2 AS q11,
  0.25::DOUBLE + {_PO}::DOUBLE ** 2 / ({_PO}::DOUBLE ** 2 + noise) * (z - 0.25::DOUBLE) AS o, 0.001::DOUBLE AS r, (1 - {_PO}::DOUBLE ** 2 / ({_PO}::DOUBLE ** 2 + noise)) * {_PO}::DOUBLE ** 2 AS p00, 0.0::DOUBLE AS p01, {_PR}::DOUBLE ** 2 AS p11 FROM ob WHERE n = 0
UNION ALL SELECT track, n, po, pr, q00, q01, q11, po + q00 / (q00 + noise) * (z - po), pr + q01 / (q00 + noise) * (z - po), (1 - q00 / (q00 + noise)) * q00, (1 - q00 / (q00 + noise)) * q01, q11 - q01 / (q00 + noise) * q01
 FROM (SELECT ob.track, ob.n, z, noise, o + r AS po, r AS pr, p00 + 2 * p01 + p11 + {_SO}::DOUBLE ** 2 + {_SR}::DOUBLE ** 2 / 3 AS q00, p01 + p11 + {_SR}::DOUBLE ** 2 / 2 AS q01, p11 + {_SR}::DOUBLE ** 2 AS q11 FROM kf JOIN ob ON ob.track = kf.track AND ob.n = kf.n + 1) x)"""


@query(f"{_KALMAN} SELECT track, n, {M('o')} AS \"offset\", {M('r')} AS rate, {M('p00')} AS p00, {M('p01')} AS p01, {M('p11')} AS p11 FROM kf")
def kalman_forward(spark, sf_dir):
    return _states(_filtered(spark, sf_dir))


@query(f"""{_KALMAN}, top AS (SELECT track, max(n) AS last FROM kf GROUP BY track), gn AS (SELECT a.track, a.n, a.o, a.r, a.p00, a.p01, a.p11, b.po, b.pr, b.q00, b.q01, b.q11, b.q00 * b.q11 - b.q01 * b.q01 AS det FROM kf a JOIN kf b ON b.track = a.track AND b.n = a.n + 1),
gg AS (SELECT *, ((p00 + p01) * q11 - p01 * q01) / det AS g00, (p01 * q00 - (p00 + p01) * q01) / det AS g01, ((p01 + p11) * q11 - p11 * q01) / det AS g10, (p11 * q00 - (p01 + p11) * q01) / det AS g11 FROM gn),
sm AS (SELECT kf.track, n, o AS so, r AS sr, p00 AS s00, p01 AS s01, p11 AS s11 FROM kf JOIN top ON top.track = kf.track AND n = last
UNION ALL SELECT g.track, g.n, o + g00 * (so - po) + g01 * (sr - pr), r + g10 * (so - po) + g11 * (sr - pr), p00 + g00 * g00 * (s00 - q00) + 2 * g00 * g01 * (s01 - q01) + g01 * g01 * (s11 - q11),
 p01 + g00 * g10 * (s00 - q00) + (g00 * g11 + g01 * g10) * (s01 - q01) + g01 * g11 * (s11 - q11), p11 + g10 * g10 * (s00 - q00) + 2 * g10 * g11 * (s01 - q01) + g11 * g11 * (s11 - q11) FROM sm JOIN gg g ON g.track = sm.track AND g.n = sm.n - 1)
SELECT track, n, {M('so')} AS "offset", {M('sr')} AS rate, {M('s00')} AS p00, {M('s01')} AS p01, {M('s11')} AS p11 FROM sm""")
def rts_smooth(spark, sf_dir):
    return _states(drift.rts_smooth(_filtered(spark, sf_dir)))


@query(f"""{_KALMAN} SELECT track, {M('median(sqrt(greatest(p00, 0)) * 1e3)')} AS median_offset_std_ms, {M('max(sqrt(greatest(p00, 0)) * 1e3)')} AS max_offset_std_ms FROM kf GROUP BY track""")
def uncertainty_summary(spark, sf_dir):
    return _uncertainty(_filtered(spark, sf_dir))


@query(f"{_KALMAN} SELECT track, n, {M('n + o')} AS master_t, {M('n + o - sqrt(greatest(p00, 0))')} AS low, {M('n + o + sqrt(greatest(p00, 0))')} AS high FROM kf")
def uncertainty_band(spark, sf_dir):
    b = drift.uncertainty_band(_filtered(spark, sf_dir))
    return b.select("track", F.col("n").cast("long").alias("n"), *(S.micro(c).alias(c) for c in ("master_t", "low", "high")))


@query(f"""{_FIT}, sg AS (SELECT track, CASE WHEN local_start >= 1600 THEN 2 WHEN local_start >= 800 THEN 1 ELSE 0 END AS segment, abs(r) AS r FROM judged WHERE included), ev AS (SELECT track, unnest([0, 1, 2]) AS segment FROM (SELECT DISTINCT track FROM m))
SELECT ev.track, ev.segment, count(r) AS n, coalesce({K('median(r)')}, 0.0) AS residual_median_ms, coalesce({K('max(r)')}, 0.0) AS residual_max_ms FROM ev LEFT JOIN sg ON sg.track = ev.track AND sg.segment = ev.segment GROUP BY ev.track, ev.segment""")
def segment_residuals(spark, sf_dir):
    _, judged = _fit(spark, sf_dir)
    breaks = judged.select("track").distinct().withColumn("breaks", F.array(F.lit(800.0), F.lit(1600.0)))
    out = drift.segment_residuals(judged, breaks)
    return out.select("track", "segment", "n", milli("residual_median_ms").alias("residual_median_ms"), milli("residual_max_ms").alias("residual_max_ms"))


@query(f"""WITH {USER_SERIES_SQL}, t AS (SELECT track, 1 + (v - 2500) / 1e6::DOUBLE AS rate, abs((v - lag(v) OVER (PARTITION BY track ORDER BY idx)) / 1e6::DOUBLE) AS turn FROM s)
SELECT track, {M('min(rate)')} AS rate_min, {M('max(rate)')} AS rate_max, {M('avg(rate)')} AS rate_mean, {K('max(abs(rate - 1)) * 1e6')} AS max_abs_rate_deviation_ppm, {K('coalesce(max(turn), 0) * 1e6')} AS max_rate_change_ppm FROM t GROUP BY track""")
def rate_figures(spark, sf_dir):
    """Spread and turns of local rates: every event is a segment's rate."""
    rates = user_series(spark, sf_dir).select("track", F.col("idx").alias("segment"), (F.lit(1.0) + (F.col("v") - 2500.0) / 1e6).alias("rate"))
    out = drift.rate_figures(rates)
    return out.select("track", *(S.micro(c).alias(c) for c in ("rate_min", "rate_max", "rate_mean")), *(milli(c).alias(c) for c in ("max_abs_rate_deviation_ppm", "max_rate_change_ppm")))


@query(f"""{_FIT}, o AS (SELECT *, CASE WHEN track % 2 = 0 THEN (master_start - (1 + 1.0002::DOUBLE * local_start)) * 1000 ELSE r END AS res, track % 2 = 0 AND included AND (local_start < 300 OR local_start > 2000) AS beyond FROM judged)
SELECT track, included AND NOT beyond AS included, CASE WHEN beyond THEN coalesce(reason, 'outside_spline_support') ELSE reason END AS reason, count(*) AS n, {K('max(abs(res))')} AS top_ms FROM o GROUP BY ALL""")
def support_marks(spark, sf_dir):
    """Matches that a selected map doesn't reach, and the residuals it leaves: splines for every other track."""
    models, judged = _fit(spark, sf_dir)
    piece = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("a"), F.lit(1.0002).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    selected = models.select("track", F.when(F.col("track") % 2 == 0, "spline").otherwise("linear").alias("model_type"), F.array(piece).alias("pieces"), F.lit(300.0).alias("support_start"), F.lit(2000.0).alias("support_end"))
    out = nonlinear.remarked(judged, selected)
    return out.groupBy("track", F.col("included_in_regression").alias("included"), F.col("rejected_reason").alias("reason")).agg(F.count("*").alias("n"), F.max(F.abs("residual_ms")).alias("top_ms")).withColumn("top_ms", milli("top_ms"))


# Selection ------------------------------------------------------------------------


def _selected(spark, sf_dir, model: str):
    """A bent map: the observations' reference runs faster in the second half."""
    o = observations(spark, sf_dir, 10)
    late = F.greatest(F.lit(0.0), F.col("local_start") - 2300.0)
    w = o.groupBy("track", "local_start").agg(F.min("match_id").alias("match_id"), F.min_by("confidence", "match_id").alias("confidence"), F.min_by("master_start", "match_id").alias("master_start"))
    w = w.withColumn("master_start", F.lit(0.75) + F.col("local_start") * 1.0001 + late * 0.0003 + (F.col("match_id") % 5 - 2) * 0.002)
    w = w.select("track", "match_id", "local_start", (F.col("local_start") + 1).alias("local_end"), "master_start", (F.col("master_start") + 1).alias("master_end"), "confidence")
    models, judged = drift.fit_linear(w)
    cfg = DriftModel(drift_model=model, allow_nonlinear_drift=model != "linear")
    return nonlinear.select_models(models, judged, cfg, _durations(judged))


def _report(df):
    return df.select("track", "model_type", "model_selection_policy", F.array_join("candidate_models", ",").alias("candidate_models"), "anchor_count", milli("residual_median_ms").alias("residual_median_ms"), milli("residual_max_ms").alias("residual_max_ms"), F.size("warnings").alias("n_warnings"), F.col("fallback_reason").isNotNull().alias("fell_back"))


@query()
def model_selection_auto(spark, sf_dir):
    return _report(_selected(spark, sf_dir, "auto"))


_BENT = (
    _FIT.replace("o_custkey % 40", "o_custkey % 10")
    .replace(", e0 AS", ", o1 AS (SELECT track, local_start, min(match_id) AS match_id, arg_min(confidence, match_id) AS confidence FROM m GROUP BY track, local_start), obs1 AS (SELECT track, match_id, local_start, confidence, 0.75::DOUBLE + local_start * 1.0001::DOUBLE + greatest(0, local_start - 2300) * 0.0003::DOUBLE + (match_id % 5 - 2) * 0.002::DOUBLE AS master_start FROM o1), e0 AS", 1)
    .replace("FROM m WHERE confidence >= 0.05", "FROM obs1 WHERE confidence >= 0.05")
    .replace("FROM m LEFT JOIN model", "FROM obs1 m LEFT JOIN model")
)


@query(f"""{_BENT}, rs AS (SELECT track, median(abs(r)) AS mid, max(abs(r)) AS top FROM judged WHERE included GROUP BY track)
SELECT track, 'linear' AS model_type, 'linear_requested' AS model_selection_policy, 'linear' AS candidate_models, n AS anchor_count, {K('mid')} AS residual_median_ms, {K('top')} AS residual_max_ms, 0 AS n_warnings, false AS fell_back FROM model JOIN rs USING (track)""")
def model_selection_linear(spark, sf_dir):
    return _report(_selected(spark, sf_dir, "linear"))


@query()
def model_selection_piecewise(spark, sf_dir):
    return _report(_selected(spark, sf_dir, "piecewise_linear"))


@query()
def model_selection_spline(spark, sf_dir):
    return _report(_selected(spark, sf_dir, "spline"))


@query()
def model_selection_kalman(spark, sf_dir):
    return _report(_selected(spark, sf_dir, "kalman"))


