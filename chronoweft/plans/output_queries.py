"""Queries: rendering, local shifts, output levels, issues, report rows, translations, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import drift, local_adjust, nonlinear, render, report, series, timeline
from ..config import DriftModel
from ..sources import locales, synthetic
from ..sources.staging import staged
from ..sources.tables import OBSERVATIONS_SQL, USER_SERIES_SQL, observations, user_series
from .activity_queries import M
from .fit_queries import _FIT, K, milli
from .registry import query

# Rendering ------------------------------------------------------------------------

#: Points of the sampled maps of the queries on selected models.
SELECTED_POINTS = 4096
_MODEL = "CASE WHEN track % 2 = 0 THEN 1.0008::DOUBLE ELSE 0.75::DOUBLE END AS stretch, (track % 7) * 1.3::DOUBLE - 2 AS off"


def _models(s):
    even = F.col("track") % 2 == 0
    return s.select("track").distinct().select("track", F.when(even, 1.0008).otherwise(0.75).alias("stretch_ratio"), ((F.col("track") % 7) * F.lit(1.3) - 2.0).alias("offset_seconds"))


@query(f"""WITH {USER_SERIES_SQL}, mo AS (SELECT DISTINCT track, {_MODEL} FROM s), la AS (SELECT track, max(idx) AS last FROM s GROUP BY track), g AS (SELECT track, unnest(range(40)) AS i FROM mo),
p AS (SELECT g.track, i, (i / 0.5::DOUBLE - off) / stretch AS p, last FROM g JOIN mo USING (track) JOIN la USING (track)), q AS (SELECT *, least(floor(p), last) AS lo, least(floor(p) + 1, last) AS hi, p >= 0 AND p <= last + 1e-9 AS ok FROM p)
SELECT q.track, q.i, {M('CASE WHEN ok THEN a.v + (least(p, last) - lo) * (b.v - a.v) ELSE 0 END')} AS v FROM q LEFT JOIN s a ON a.track = q.track AND a.idx = lo LEFT JOIN s b ON b.track = q.track AND b.idx = hi""")
def render_linear(spark, sf_dir):
    """80 seconds of every user's series at half a sample a second, through its line."""
    s = user_series(spark, sf_dir)
    m = _models(s)
    out = timeline.render_linear(s, m, m.select("track", F.lit(80.0).alias("master_total")), 1.0, 0.5)
    return out.withColumn("v", S.micro("v"))


def _table(spark, sf_dir, points: int = 64):
    """Sampled maps with a jump of 30 for every third track."""
    s = user_series(spark, sf_dir)
    extents = s.groupBy("track").agg((F.max("idx") + 1.0).alias("total"))
    t = timeline.sampled_times(extents, points)
    jump = F.when((F.col("track") % 3 == 0) & (F.col("local_t") > 25.5), 30.0).otherwise(0.0)
    return s, t.withColumn("master_t", F.lit(0.5) + F.col("local_t") * 1.25 + jump)


_TABLE = f"""{USER_SERIES_SQL}, ex AS (SELECT track, max(idx) + 1.0::DOUBLE AS total FROM s GROUP BY track), kk AS (SELECT track, total, unnest(range(64)) AS k FROM ex),
tb AS (SELECT track, k, total * k / 63.0::DOUBLE AS local_t, 0.5::DOUBLE + total * k / 63.0::DOUBLE * 1.25::DOUBLE + CASE WHEN track % 3 = 0 AND total * k / 63.0::DOUBLE > 25.5 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS master_t FROM kk),
st AS (SELECT *, lead(master_t) OVER w - master_t AS step, lead(master_t) OVER w AS me, lead(local_t) OVER w AS le FROM tb WINDOW w AS (PARTITION BY track ORDER BY k))"""


@query(f"WITH {_TABLE} SELECT track, count(*) AS n, {M('min(step)')} AS min_step, {M('median(step)')} AS median_step, bool_and(step > 1e-9) AS rising FROM st GROUP BY track")
def inverse_map_check(spark, sf_dir):
    c = timeline.map_check(_table(spark, sf_dir)[1])
    return c.select("track", "n", S.micro("min_step").alias("min_step"), S.micro("median_step").alias("median_step"), "rising")


@query(f"WITH {_TABLE}, md AS (SELECT track, median(step) AS typical FROM st GROUP BY track) SELECT track, k, {M('master_t')} AS master_t, {M('me')} AS master_end FROM st JOIN md USING (track) WHERE step > typical * 8")
def map_gaps(spark, sf_dir):
    g = timeline.gap_candidates(_table(spark, sf_dir)[1])
    return g.select("track", F.col("k").cast("long").alias("k"), S.micro("master_t").alias("master_t"), S.micro("master_end").alias("master_end"))


@query(f"""WITH {_TABLE}, sp AS (SELECT track, min(master_t) AS a, max(master_t) AS b FROM tb GROUP BY track)
SELECT track, 0.0::DOUBLE AS start, {M('a')} AS "end", 'before_drift_model_support' AS reason FROM sp UNION ALL SELECT track, {M('b')}, 150.0::DOUBLE, 'after_drift_model_support' FROM sp WHERE b < 150""")
def unsupported_regions(spark, sf_dir):
    t = _table(spark, sf_dir)[1]
    e = t.groupBy("track").agg(F.min("master_t").alias("support_start"), F.max("master_t").alias("support_end")).withColumn("master_start", F.lit(0.0)).withColumn("master_end", F.lit(150.0))
    r = timeline.unsupported_regions(e)
    return r.select("track", S.micro("start").alias("start"), S.micro("end").alias("end"), "reason")


@query(f"""WITH {_TABLE}, la AS (SELECT track, max(idx) AS last FROM s GROUP BY track), md AS (SELECT track, median(step) AS typical FROM st GROUP BY track), g AS (SELECT track, unnest(range(40)) AS i FROM la),
x AS (SELECT g.track, i, last, CASE WHEN step > typical * 8 AND i * 2.0::DOUBLE > master_t THEN NULL ELSE local_t + (i * 2.0::DOUBLE - master_t) / (me - master_t) * (le - local_t) END AS p
 FROM g JOIN la ON la.track = g.track JOIN md ON md.track = g.track LEFT JOIN st ON st.track = g.track AND i * 2.0::DOUBLE >= master_t AND i * 2.0::DOUBLE < me),
q AS (SELECT *, least(floor(p), last) AS lo, least(floor(p) + 1, last) AS hi, p >= 0 AND p <= last + 1e-9 AS ok FROM x)
SELECT q.track, q.i, {M('CASE WHEN ok THEN a.v + (least(p, last) - lo) * (b.v - a.v) ELSE 0 END')} AS v FROM q LEFT JOIN s a ON a.track = q.track AND a.idx = lo LEFT JOIN s b ON b.track = q.track AND b.idx = hi""")
def render_map(spark, sf_dir):
    """The same rendering through sampled maps, silent in their gaps."""
    s, t = _table(spark, sf_dir)
    gaps = timeline.gap_candidates(t).select("track", F.col("master_t").alias("gap_start"), F.col("master_end").alias("gap_end"))
    ex = s.select("track").distinct().withColumn("master_total", F.lit(80.0))
    return timeline.render_table(s, t, ex, 1.0, 0.5, gaps).withColumn("v", S.micro("v"))


def _selected(spark, sf_dir):
    """A model for every user's series: a line, or two pieces with a jump between them for every third."""
    s = user_series(spark, sf_dir)
    piece = lambda *v: F.struct(*(F.lit(x).cast("double").alias(n) for n, x in zip("start a b c d".split(), v)))
    late = 0.5 + 25.5 * 1.25 + 30.0
    jumps = F.col("track") % 3 == 0
    pieces = F.when(jumps, F.array(piece(0, 0.5, 1.25, 0, 0), piece(25.5, late, 1.25, 0, 0))).otherwise(F.array(piece(0, 0.5, 1.25, 0, 0)))
    tracks = s.groupBy("track").agg((F.max("idx") + 1.0).alias("total")).withColumn("total", F.when(F.col("track") % 7 != 5, F.col("total")).otherwise(0.0)).withColumn("master_total", F.lit(80.0))
    return s, tracks.select("track", F.when(jumps, "piecewise_linear").otherwise("linear").alias("model_type"), pieces.alias("pieces")), tracks


_SELECTED = f"""{USER_SERIES_SQL}, ex AS (SELECT track, max(idx) + 1.0::DOUBLE AS total, max(idx) AS last, track % 3 = 0 AND max(idx) + 1 > 25.5 AS jumps FROM s GROUP BY track)"""


@query(f"""WITH {_SELECTED}, g AS (SELECT track, last, jumps, unnest(range(40)) AS i FROM ex WHERE track % 7 <> 5), x AS (SELECT *, i * 2.0::DOUBLE AS mt FROM g),
y AS (SELECT *, CASE WHEN NOT jumps OR mt <= 32.375 THEN (mt - 0.5) / 1.25 WHEN mt >= 62.375 THEN (mt - 30.5) / 1.25 END AS p FROM x),
q AS (SELECT *, least(floor(p), last) AS lo, least(floor(p) + 1, last) AS hi, p >= 0 AND p <= last + 1e-9 AS ok FROM y)
SELECT q.track, q.i, {K('CASE WHEN ok THEN a.v + (least(p, last) - lo) * (b.v - a.v) ELSE 0 END')} AS v FROM q LEFT JOIN s a ON a.track = q.track AND a.idx = lo LEFT JOIN s b ON b.track = q.track AND b.idx = hi
UNION ALL SELECT track, unnest(range(40)), 0.0::DOUBLE FROM ex WHERE track % 7 = 5""")
def render_selected(spark, sf_dir):
    """Every series through its own selected map: lines, maps with a jump, and tracks without samples."""
    s, selected, tracks = _selected(spark, sf_dir)
    made = render.render(s.where("track % 7 <> 5"), selected, tracks.withColumn("master_total", F.lit(40.0 * 2)), 1.0, points=SELECTED_POINTS, stage=staged).samples
    return made.where("i % 2 = 0").select("track", (F.col("i") / 2).cast("long").alias("i"), milli("v").alias("v"))


@query(f"""WITH {_SELECTED}, f AS (SELECT track, 0.5::DOUBLE AS a, 0.5 + total * 1.25::DOUBLE + CASE WHEN jumps THEN 30 ELSE 0 END AS b, jumps, track % 7 = 5 AS silent FROM ex)
SELECT track, 0.0::DOUBLE AS start, CASE WHEN silent THEN 80.0::DOUBLE ELSE 0.5::DOUBLE END AS "end", CASE WHEN silent THEN 'empty_source_track' ELSE 'before_drift_model_support' END AS reason FROM f
UNION ALL SELECT track, {K('b')}, 80.0::DOUBLE, 'after_drift_model_support' FROM f WHERE NOT silent AND b < 80
UNION ALL SELECT track, 32.375::DOUBLE, 62.375::DOUBLE, 'internal_drift_model_gap' FROM f WHERE NOT silent AND jumps""")
def silent_regions(spark, sf_dir):
    """What the selected maps leave silent, jumps found by bisection."""
    s, selected, tracks = _selected(spark, sf_dir)
    r = render.render(s.where("track % 7 <> 5"), selected, tracks, 1.0, points=SELECTED_POINTS, stage=staged).regions
    return r.select("track", milli("start").alias("start"), milli("end").alias("end"), "reason")


@query(f"""WITH {_TABLE}, w AS (SELECT track, k, least(CAST(round_even(local_t * 4, 0) AS BIGINT), CAST(max(local_t) OVER (PARTITION BY track) * 4 AS BIGINT)) AS source, CAST(max(local_t) OVER (PARTITION BY track) * 4 AS BIGINT) AS n, CAST(round_even((master_t - 0.5::DOUBLE) * 4, 0) AS BIGINT) AS t0 FROM tb),
z AS (SELECT *, greatest(1, max(t0) OVER (PARTITION BY track)) AS m FROM w), c AS (SELECT track, k, source, least(t0, m - 1) AS target, n, m FROM z),
u AS (SELECT *, coalesce(source > max(source) OVER o, true) AND coalesce(target > max(target) OVER o, true) AS up FROM c WHERE source < n WINDOW o AS (PARTITION BY track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT track, k, source, target FROM u WHERE up UNION ALL SELECT DISTINCT track, 64, n, m FROM c""")
def time_map_points(spark, sf_dir):
    """Sampled maps in whole samples, both sides strictly rising, for stretchers that follow a map."""
    s, t = _table(spark, sf_dir)
    lengths = s.groupBy("track").agg(((F.max("idx") + 1) * 4).alias("n"))
    out = timeline.time_map(t, lengths, 4.0)
    return out.select("track", F.col("k").cast("long").alias("k"), "source", "target")


@query(f"WITH {USER_SERIES_SQL} SELECT track, idx + CAST(round_even((track % 7 * 1.3 - 2)::DOUBLE, 0) AS BIGINT) AS i, v FROM s WHERE idx + round_even((track % 7 * 1.3 - 2)::DOUBLE, 0) BETWEEN 0 AND 59")
def placed_samples(spark, sf_dir):
    s = user_series(spark, sf_dir)
    return timeline.placed(s, _models(s).select("track", "offset_seconds"), s.select("track").distinct().withColumn("master_total", F.lit(60.0)), 1.0)


@query(f"WITH {USER_SERIES_SQL}, p AS (SELECT track, max(abs(v)) AS peak FROM s GROUP BY track) SELECT track, idx, {M('greatest(-1, least(1, v / peak))')} AS v FROM s JOIN p USING (track)")
def peak_normalize(spark, sf_dir):
    return timeline.peak_scaled(user_series(spark, sf_dir), True).withColumn("v", S.micro("v"))


@query(f"WITH {USER_SERIES_SQL}, p AS (SELECT track, max(abs(v)) AS peak FROM s GROUP BY track) SELECT track, idx, CAST(trunc(greatest(-1, least(1, v / greatest(peak, 1))) * 32767) AS SMALLINT) AS pcm FROM s JOIN p USING (track)")
def pcm16(spark, sf_dir):
    s = user_series(spark, sf_dir)
    p = s.groupBy("track").agg(F.max(F.abs("v")).alias("peak"))
    return s.join(p, "track").select("track", "idx", S.pcm16("v", "peak").alias("pcm"))


@query(f"WITH {USER_SERIES_SQL}, a AS (SELECT track, avg(v) AS m FROM s GROUP BY track), r AS (SELECT track, m, sqrt(avg((v - m) * (v - m))) AS rms FROM s JOIN a USING (track) GROUP BY ALL) SELECT track, idx, {M('CASE WHEN rms <= 1e-12 THEN 0 ELSE (v - m) / rms END')} AS v FROM s JOIN r USING (track)")
def robust_normalize(spark, sf_dir):
    """Zero mean and unit level for every series."""
    s = user_series(spark, sf_dir)
    a = s.groupBy("track").agg(F.avg("v").alias("m"))
    r = s.join(a, "track").groupBy("track", "m").agg(F.sqrt(F.avg((F.col("v") - F.col("m")) ** 2)).alias("rms"))
    v = F.when(F.col("rms") <= 1e-12, 0.0).otherwise((F.col("v") - F.col("m")) / F.col("rms"))
    return s.join(r, "track").select("track", "idx", S.micro(v).alias("v"))


@query(f"WITH {USER_SERIES_SQL} SELECT a.idx, {M('avg(v)')} AS v FROM s a GROUP BY a.idx")
def mono_mix(spark, sf_dir):
    """Channels (here: tracks) averaged sample by sample."""
    return user_series(spark, sf_dir).groupBy("idx").agg(S.micro(F.avg("v")).alias("v"))


# Local shifts ----------------------------------------------------------------------


def _silence(spark, sf_dir):
    s = observations(spark, sf_dir)
    return s.where("match_id % 3 = 0").select("track", F.col("local_start").alias("start"), (F.col("local_start") + 0.5).alias("end"))


@query(f"""{_FIT}, big AS (SELECT * FROM judged WHERE included AND abs(r) >= 15), si AS (SELECT track, local_start AS a, local_start + 0.5 AS b FROM m WHERE match_id % 3 = 0),
c AS (SELECT big.track, match_id, r, a, least(greatest(local_start, a), b) AS pl, local_start AS t FROM big JOIN si ON si.track = big.track AND b >= local_start - 0.4 AND a <= local_start + 0.4)
SELECT track, match_id, {M("arg_min(pl, {'d': abs(pl - t), 'a': a})")} AS split_time, {K('any_value(-r / 1000)')} AS shift_seconds, {M('0.5 * 0 + any_value(floor(greatest(0, 1 - least(1, abs(r) / 300)) * 100 + 0.5) / 100)')} AS confidence FROM c GROUP BY track, match_id""")
def local_adjust_events(spark, sf_dir):
    _, judged = drift.fit_linear(observations(spark, sf_dir))
    found, _ = local_adjust.events(judged, _silence(spark, sf_dir), 15.0)
    return found.select("track", "match_id", S.micro("split_time").alias("split_time"), milli("shift_seconds").alias("shift_seconds"), S.micro(F.floor(F.col("confidence") * 100 + 0.5) / 100).alias("confidence"))


@query(f"""WITH RECURSIVE {USER_SERIES_SQL}, sz AS (SELECT track, max(idx) + 1 AS n FROM s GROUP BY track), ev AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY idx) AS k, idx AS c, CAST(v % 7 - 3 AS BIGINT) AS m FROM s WHERE idx % 25 = 10),
mv AS (SELECT s.track, idx AS home, idx AS p, n, CAST(0 AS BIGINT) AS k FROM s JOIN sz USING (track)
 UNION ALL SELECT mv.track, home, CASE WHEN p < 0 OR p < c OR c >= n THEN p WHEN m >= 0 THEN CASE WHEN p + m >= n THEN -1 ELSE p + m END ELSE CASE WHEN p + m < c THEN -1 ELSE p + m END END, n, mv.k + 1 FROM mv JOIN ev ON ev.track = mv.track AND ev.k = mv.k + 1),
fi AS (SELECT mv.track, home, p FROM mv JOIN (SELECT track, count(*) AS z FROM ev GROUP BY track) USING (track) WHERE mv.k = z UNION ALL SELECT s.track, idx, idx FROM s WHERE track NOT IN (SELECT track FROM ev))
SELECT s.track, s.idx, coalesce(o.v, 0.0) AS v FROM s LEFT JOIN fi ON fi.track = s.track AND fi.p = s.idx LEFT JOIN s o ON o.track = fi.track AND o.idx = fi.home""")
def local_adjust_shift(spark, sf_dir):
    s = user_series(spark, sf_dir)
    ev = s.where("idx % 25 = 10").select("track", F.col("idx").alias("match_id"), F.col("idx").cast("double").alias("split_time"), (F.col("v") % 7 - 3).alias("shift_seconds"))
    return local_adjust.shifted(s, ev, 1.0)


# Issues and reports ----------------------------------------------------------------


def _issues(spark, sf_dir):
    o = observations(spark, sf_dir, 400).withColumn("master_start", F.col("master_start") + (F.col("match_id") % 13 - 6) * 0.02)
    models, judged = drift.fit_linear(o)
    every = o.select("track").distinct().unionByName(o.select((F.col("track") + 1000).alias("track")).where("track < 1005").distinct())
    return every, models, judged


_ISSUES = _FIT.replace("o_custkey % 40", "o_custkey % 400").replace(", e0 AS", ", obs1 AS (SELECT * REPLACE (master_start + (match_id % 13 - 6) * 0.02 AS master_start) FROM m), e0 AS").replace("FROM m WHERE confidence >= 0.05", "FROM obs1 WHERE confidence >= 0.05").replace("FROM m LEFT JOIN model", "FROM obs1 m LEFT JOIN model")
_RULES = f"""{_ISSUES}, rs AS (SELECT track, median(abs(r)) AS mid, max(abs(r)) AS top FROM judged WHERE included GROUP BY track), ev AS (SELECT DISTINCT track FROM obs1 UNION SELECT DISTINCT track + 1000 FROM obs1 WHERE track < 5),
al AS (SELECT ev.track, n, mid, top FROM ev LEFT JOIN (SELECT * FROM model JOIN rs USING (track)) USING (track)),
iss AS (SELECT track, 0 AS seq, 'error' AS severity, 'ALIGNMENT_FAILED' AS code FROM al WHERE n IS NULL
 UNION ALL SELECT track, 1, CASE WHEN n < 3 THEN 'error' ELSE 'warning' END, CASE WHEN n < 3 THEN 'INSUFFICIENT_ANCHORS' ELSE 'LOW_ANCHOR_COUNT' END FROM al WHERE n < 8
 UNION ALL SELECT track, 2, CASE WHEN mid >= 80 OR top >= 250 THEN 'error' ELSE 'warning' END, CASE WHEN mid >= 80 OR top >= 250 THEN 'HIGH_RESIDUALS' ELSE 'ELEVATED_RESIDUALS' END FROM al WHERE mid >= 30 OR top >= 100)"""


@query(f"{_RULES} SELECT track, seq, severity, code FROM iss")
def issue_rules(spark, sf_dir):
    every, models, _ = _issues(spark, sf_dir)
    return report.model_issues(every, models).select("track", "seq", "severity", "code")


@query(f"{_RULES} SELECT DISTINCT track % 10 AS track, severity, code FROM iss")
def issue_dedup(spark, sf_dir):
    """The first of the issues that say the same, tracks folded to ten."""
    every, models, _ = _issues(spark, sf_dir)
    i = report.model_issues(every, models).withColumn("seq", F.col("track") * 10 + F.col("seq")).withColumn("track", F.col("track") % 10)
    return report.distinct_issues(i).select("track", "severity", "code")


@query(f"{_RULES} SELECT '[' || upper(severity) || '] track=' || track || ' time=' || CASE WHEN seq = 0 THEN 'n/a' ELSE format('{{:.3f}}s', seq * 1.5::DOUBLE) END || ' code=' || code || ' msg=warnings.' || lower(code) AS line FROM iss")
def warning_lines(spark, sf_dir):
    every, models, _ = _issues(spark, sf_dir)
    i = report.model_issues(every, models).withColumn("time_seconds", F.when(F.col("seq") > 0, F.col("seq") * 1.5))
    return i.select(report.warning_line().alias("line"))


@query(f"""{_FIT} SELECT track, local_start, local_end, {M('master_start')} AS master_start, {M('master_end')} AS master_end, {M('master_start - local_start')} AS offset_seconds, {K('r')} AS residual_ms, confidence, NULL::DOUBLE AS score FROM judged""")
def marker_csv(spark, sf_dir):
    _, judged = drift.fit_linear(observations(spark, sf_dir))
    rows = judged.withColumn("offset_seconds", S.micro(F.col("master_start") - F.col("local_start"))).withColumn("residual_ms", milli("residual_ms"))
    return report.markers(rows.withColumn("master_start", S.micro("master_start")).withColumn("master_end", S.micro("master_end")))


@query(f"{_RULES} SELECT track, count(*) AS n, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM iss GROUP BY track")
def issue_codes(spark, sf_dir):
    every, models, _ = _issues(spark, sf_dir)
    return report.codes(report.model_issues(every, models)).select("track", "n", F.array_join("codes", ",").alias("codes"))


def _reports(spark, sf_dir):
    """The reports' rows, the issues, and the reference, of matches fitted by lines."""
    every, models, judged = map(staged, _issues(spark, sf_dir))
    issues = report.distinct_issues(report.model_issues(every, models))
    totals = judged.groupBy("track").agg((F.max("local_start") + 100.0).alias("total"))
    selected = nonlinear.with_gaps(nonlinear.select_models(models, judged, DriftModel(drift_model="linear"), totals), drift.unsupported(judged, 90.0))
    none = selected.select("track", F.lit("x").alias("reason")).where(F.lit(False))
    rows = report.track_reports(every.join(totals, "track", "left"), selected, judged, issues, none, drift.diagnostics(models, judged, totals))
    return rows, issues, spark.createDataFrame([("reference", 3000.0)], "name string, duration_seconds double")


_COUNTS = f"""{_RULES}, jm AS (SELECT track, count(*) AS n, count(*) FILTER (included) AS inc FROM judged GROUP BY track), ic AS (SELECT track, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'error') AS e FROM iss GROUP BY track)"""
_GET = {
    "anchor_count": "long", "drift_anchor_match_summary.count": "long", "drift_anchor_match_summary.included_count": "long", "model_type": "string", "model_selection_policy": "string",
    "model_version": "string", "drift_fit_summary.fitted_anchor_count": "long", "unsupported_region_summary.count": "long",
}


@query(f"""{_COUNTS} SELECT ev.track, al.n AS anchor_count, jm.n AS "drift_anchor_match_summary_count", inc AS "drift_anchor_match_summary_included_count", CASE WHEN al.n IS NOT NULL THEN 'linear' END AS model_type, CASE WHEN al.n IS NOT NULL THEN 'linear_requested' END AS model_selection_policy,
CASE WHEN al.n IS NOT NULL THEN '1' END AS model_version, al.n AS "drift_fit_summary_fitted_anchor_count", CAST(NULL AS BIGINT) AS "unsupported_region_summary_count", coalesce(w, 0) AS n_warnings, coalesce(e, 0) AS n_errors
FROM ev LEFT JOIN al USING (track) LEFT JOIN jm USING (track) LEFT JOIN ic USING (track)""")
def track_report(spark, sf_dir):
    """Each track's report, read again from its JSON."""
    rows, _, _ = _reports(spark, sf_dir)
    size = lambda name: F.json_array_length(F.get_json_object("report", f"$.{name}")).cast("long").alias(f"n_{name}")
    return rows.select("track", *(F.get_json_object("report", f"$.{n}").cast(t).alias(n.replace(".", "_")) for n, t in _GET.items()), size("warnings"), size("errors"))


@query(f"""{_RULES} SELECT 'track' AS kind, CAST(track AS VARCHAR) AS track, '' AS code FROM ev UNION ALL SELECT severity, CAST(track AS VARCHAR), code FROM iss UNION ALL SELECT 'report', 'reference', 'alignment_diagnostics'""")
def report_document(spark, sf_dir):
    """The whole report, line by line, read again: its head, its tracks, its warnings and errors."""
    rows, issues, master = _reports(spark, sf_dir)
    lines = report.document({"sample_rate": 16000}, master, rows, issues)
    text = F.regexp_replace("line", "^,", "")
    get = lambda path: F.get_json_object(text, path)
    head = lines.where("part = 0").select(F.lit("report").alias("kind"), F.regexp_extract("line", r'"name":"([^"]*)"', 1).alias("track"), F.regexp_extract("line", r'"report_type":"([^"]*)"', 1).alias("code"))
    tracks = lines.where("part = 1").select(F.lit("track").alias("kind"), get("$.name").alias("track"), F.lit("").alias("code"))
    found = lines.where("part IN (3, 5)").select(get("$.severity").alias("kind"), get("$.speaker_track").alias("track"), get("$.code").alias("code"))
    return head.unionByName(tracks).unionByName(found)


def _catalog(spark):
    return locales.catalog(spark)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CATALOG = "cat(locale, key, message) AS (VALUES " + ", ".join(f"({_quoted(loc)}, {_quoted(k)}, {_quoted(m)})" for loc, d in report.MESSAGES.items() for k, m in d.items()) + ")"


@query(f"{_RULES}, {_CATALOG}, q AS (SELECT DISTINCT 'warnings.' || lower(code) AS key FROM iss UNION SELECT 'warnings.unheard_of') SELECT q.key, coalesce(a.message, b.message, q.key) AS text FROM q LEFT JOIN cat a ON a.key = q.key AND a.locale = 'de' LEFT JOIN cat b ON b.key = q.key AND b.locale = 'en'")
def i18n_lookup(spark, sf_dir):
    every, models, _ = _issues(spark, sf_dir)
    keys = report.model_issues(every, models).select(F.col("message").alias("key")).unionByName(spark.createDataFrame([("warnings.unheard_of",)], "key string")).distinct()
    return report.translated(keys, _catalog(spark), "key", "de")


@query(f"WITH {_CATALOG} SELECT 'de' AS locale, key, 'missing' AS problem FROM cat WHERE locale = 'en' AND key NOT IN (SELECT key FROM cat WHERE locale = 'de')")
def locale_diff(spark, sf_dir):
    return report.locale_errors(_catalog(spark))


@query(f"WITH {OBSERVATIONS_SQL} SELECT track, {M('(1.0008::DOUBLE - 1) * max(local_end) * 1000')} AS drift_ms FROM m GROUP BY track")
def drift_at_end(spark, sf_dir):
    o = observations(spark, sf_dir).groupBy("track").agg(F.max("local_end").alias("duration")).withColumn("stretch", F.lit(1.0008))
    return o.select("track", S.micro(report.drift_at_end("stretch", "duration")).alias("drift_ms"))


@query()
def calibration_pack(spark, sf_dir):
    """Energy by second of the generated cases' references."""
    local, out = synthetic.program(spark, 1000), None
    for name, (mapping, dropout) in synthetic.CASES.items():
        m = synthetic.heard(local, mapping, 1000, 27.0, dropout)
        e = series.frame_energy(m.select(F.lit(name).alias("track"), "idx", "v"), 1000, 1000).select("track", "frame", S.micro("energy").alias("energy"))
        out = e if out is None else out.unionByName(e)
    return out


@query()
def full_alignment(spark, sf_dir):
    """Every stage at once: two generated recordings found again on their reference."""
    from .alignment import AnchorSelection, Options, align

    local = synthetic.program(spark, 500)
    reference = synthetic.heard(local, lambda t: synthetic.constant(t, 0.75, 1.0), 500, 27.0)
    both = local.select(F.lit("near").alias("track"), "idx", "v").unionByName(local.select(F.lit("soft").alias("track"), "idx", (F.col("v") * 0.5).alias("v")))
    a = align(both, reference, Options(sample_rate=500, selection=AnchorSelection(min_anchor_count=8)))
    return a.models.join(a.offsets.select("track", "band", "radius_reason"), "track").select("track", "band", "radius_reason", "anchor_count", S.micro("stretch_ratio").alias("stretch_ratio"), milli("offset_seconds").alias("offset_seconds"))


@query(f"""WITH {USER_SERIES_SQL}, z AS (SELECT track, max(idx) + 1 AS n, CASE WHEN track % 2 = 0 THEN 1.25::DOUBLE ELSE 0.6::DOUBLE END AS ratio FROM s GROUP BY track),
g AS (SELECT track, n, unnest(range(greatest(1, CAST(round_even(n * ratio, 0) AS BIGINT)))) AS i, greatest(1, CAST(round_even(n * ratio, 0) AS BIGINT)) AS m FROM z),
p AS (SELECT track, i, n, CASE WHEN m > 1 THEN i * (n - 1) / (m - 1)::DOUBLE ELSE 0.0::DOUBLE END AS p FROM g), q AS (SELECT *, least(floor(p), n - 1) AS lo, least(floor(p) + 1, n - 1) AS hi FROM p)
SELECT q.track, q.i AS idx, {M('a.v + (least(p, n - 1) - lo) * (b.v - a.v)')} AS v FROM q JOIN s a ON a.track = q.track AND a.idx = lo JOIN s b ON b.track = q.track AND b.idx = hi""")
def stretch_linear(spark, sf_dir):
    from ..operators.stretch import stretched

    s = user_series(spark, sf_dir)
    ratios = s.select("track").distinct().withColumn("ratio", F.when(F.col("track") % 2 == 0, 1.25).otherwise(0.6))
    return stretched(s, ratios).withColumn("v", S.micro("v"))
