"""Queries: interval algebra, as-of joins, interpolation, segment lookup, event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins, series
from ..sources.tables import TYPE_SERIES_SQL, USER_SERIES_SQL, epoch_seconds, table, type_series, user_series
from ..streaming import events as stream
from .activity_queries import M
from .registry import query

_INTERVALS = f"""{USER_SERIES_SQL}, iv AS (SELECT track, idx, idx * 60.0::DOUBLE AS a, idx * 60.0::DOUBLE + v / 100.0::DOUBLE AS b FROM s)"""
_MERGED = f"""{_INTERVALS}, o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY track ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM iv),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
merged AS (SELECT track, min(a) AS a, max(b) AS b FROM isl GROUP BY track, island)"""
_FREE = f"""{_MERGED}, free0 AS (SELECT track, coalesce(lag(b) OVER (PARTITION BY track ORDER BY a), 0.0::DOUBLE) AS a, a AS b FROM merged
UNION ALL SELECT track, max(b), max(t) FROM merged JOIN (SELECT track, (max(idx) + 1) * 60.0::DOUBLE AS t FROM s GROUP BY track) USING (track) GROUP BY track),
free AS (SELECT * FROM free0 WHERE a < b)"""


def _intervals(spark, sf_dir):
    s = user_series(spark, sf_dir)
    a = F.col("idx") * F.lit(60.0)
    return s.select("track", "idx", a.alias("start"), (a + F.col("v") / 100.0).alias("end"))


def _free(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    totals = iv.groupBy("track").agg(((F.max("idx") + 1) * F.lit(60.0)).alias("total"))
    return series.complement(iv, totals)


@query(f"""WITH {_MERGED} SELECT track, {M('a')} AS start, {M('b')} AS "end" FROM merged""")
def interval_merge(spark, sf_dir):
    return series.merged(_intervals(spark, sf_dir)).select("track", S.micro("start").alias("start"), S.micro("end").alias("end"))


@query(f"""WITH {_FREE} SELECT track, {M('a')} AS start, {M('b')} AS "end" FROM free""")
def interval_complement(spark, sf_dir):
    return _free(spark, sf_dir).select("track", S.micro("start").alias("start"), S.micro("end").alias("end"))


@query(f"""WITH {_MERGED}, q AS (SELECT track, idx AS k, idx * 400.0::DOUBLE AS x, idx * 400.0::DOUBLE + 250 AS y FROM s)
SELECT q.track, k, {M('least(1, coalesce(sum(CASE WHEN a IS NOT NULL THEN least(y, b) - greatest(x, a) END), 0) / 250.0::DOUBLE)')} AS overlap_ratio
FROM q LEFT JOIN merged ON q.track = merged.track AND x < b AND a < y GROUP BY q.track, k""")
def overlap_ratio(spark, sf_dir):
    """Every event asks; intervals past the series' end overlap nothing."""
    iv = _intervals(spark, sf_dir)
    solid = series.merged(iv).select("track", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    x = F.col("idx") * F.lit(400.0)
    asked = iv.select("track", F.col("idx").alias("k"), x.alias("l_start"), (x + 250.0).alias("l_end"))
    return joins.overlap_ratio(asked, solid, 300.0, ["track", "k"]).select("track", "k", S.micro("overlap_ratio").alias("overlap_ratio"))


@query(f"""WITH {_FREE}, p AS (SELECT track, idx AS k, idx * 60.0::DOUBLE + 31.7 AS t FROM s), c AS (SELECT p.track, k, t, a, least(greatest(t, a), b) AS pl FROM p JOIN free ON p.track = free.track AND b >= t - 15 AND a <= t + 15),
best AS (SELECT track, k, arg_min(pl, {{'d': abs(pl - t), 'a': a}}) AS nearest FROM c GROUP BY track, k)
SELECT p.track, p.k, {M('nearest')} AS nearest FROM p LEFT JOIN best ON p.track = best.track AND p.k = best.k""")
def nearest_silence(spark, sf_dir):
    points = user_series(spark, sf_dir).select("track", F.col("idx").alias("k"), (F.col("idx") * F.lit(60.0) + 31.7).alias("t"))
    found = joins.nearest_interval(points, _free(spark, sf_dir), "t", 15.0, ["track", "k"])
    return found.select("track", "k", S.micro("nearest").alias("nearest"))


_KNOTS = f"""{USER_SERIES_SQL}, kn AS (SELECT track, idx * 1.0::DOUBLE AS x, v AS y FROM s WHERE idx % 5 = 2),
pc AS (SELECT * FROM (SELECT track, x AS x0, lead(x) OVER w AS x1, y AS y0, lead(y) OVER w AS y1, row_number() OVER w AS no FROM kn WINDOW w AS (PARTITION BY track ORDER BY x)) WHERE x1 IS NOT NULL),
pt AS (SELECT track, idx, idx + 0.25::DOUBLE AS t FROM s WHERE idx % 3 = 0),
hit AS (SELECT pt.track, idx, t, arg_max(pc, x0) FILTER (x0 <= t) AS p, arg_min(pc, x0) AS f FROM pt LEFT JOIN pc ON pt.track = pc.track GROUP BY ALL),
h AS (SELECT track, idx, t, coalesce(p, f) AS q FROM hit)"""


def _knots(spark, sf_dir):
    s = user_series(spark, sf_dir)
    knots = s.where("idx % 5 = 2").select("track", F.col("idx").cast("double").alias("x"), F.col("v").alias("y"))
    return knots, s.where("idx % 3 = 0").select("track", "idx", (F.col("idx") + F.lit(0.25)).alias("t"))


_LINE = "q.y0 + (t - q.x0) / (q.x1 - q.x0) * (q.y1 - q.y0)"


@query(f"WITH {_KNOTS} SELECT track, idx, {M(f'CASE WHEN t >= q.x0 AND t <= q.x1 THEN {_LINE} END')} AS value FROM h")
def asof_interp(spark, sf_dir):
    knots, points = _knots(spark, sf_dir)
    return joins.interpolated(points, knots, "t", "x", "y").select("track", "idx", S.micro("value").alias("value"))


@query(f"WITH {_KNOTS} SELECT track, idx, {M(_LINE)} AS value FROM h")
def asof_extrapolate(spark, sf_dir):
    knots, points = _knots(spark, sf_dir)
    return joins.interpolated(points, knots, "t", "x", "y", extrapolate=True).select("track", "idx", S.micro("value").alias("value"))


@query(f"WITH {_KNOTS} SELECT track, idx, {M('1 + (q.y1 - q.y0) / (q.x1 - q.x0)')} AS rate FROM h")
def asof_rate(spark, sf_dir):
    knots, points = _knots(spark, sf_dir)
    return joins.slope_at(points, knots, "t", "x", "y").select("track", "idx", S.micro("rate").alias("rate"))


@query(f"""WITH {_KNOTS}, cell AS (SELECT track, x, coalesce((lag(x) OVER w + x) / 2, '-infinity'::DOUBLE) AS l, coalesce((x + lead(x) OVER w) / 2, 'infinity'::DOUBLE) AS r FROM kn WINDOW w AS (PARTITION BY track ORDER BY x))
SELECT cell.track, x AS knot, count(idx) AS n FROM cell LEFT JOIN pt ON pt.track = cell.track AND t >= l AND t < r GROUP BY ALL""")
def knot_assignment(spark, sf_dir):
    knots, points = _knots(spark, sf_dir)
    n = joins.knot_cells(points, knots, "t", "x").groupBy("track", "knot").agg(F.count("*").alias("n"))
    return knots.select("track", F.col("x").alias("knot")).join(n, ["track", "knot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""WITH {USER_SERIES_SQL}, sg AS (SELECT track, idx + 2.0::DOUBLE AS a, idx + 11.0::DOUBLE AS b FROM s WHERE idx % 7 = 0), pt AS (SELECT track, idx, idx + 0.5::DOUBLE AS t FROM s),
e AS (SELECT track, min(a) AS first_a, max(a) AS last_a FROM sg GROUP BY track), h AS (SELECT pt.track, idx, min(a) AS a FROM pt JOIN sg ON sg.track = pt.track AND t >= a AND t <= b GROUP BY ALL)
SELECT pt.track, pt.idx, CASE WHEN t <= first_a THEN first_a ELSE coalesce(h.a, last_a) END AS seg_start FROM pt JOIN e ON e.track = pt.track LEFT JOIN h ON h.track = pt.track AND h.idx = pt.idx""")
def segment_lookup(spark, sf_dir):
    s = user_series(spark, sf_dir)
    segs = s.where("idx % 7 = 0").select("track", (F.col("idx") + 2.0).alias("seg_start"), (F.col("idx") + 11.0).alias("seg_end"))
    points = s.select("track", "idx", (F.col("idx") + 0.5).alias("t"))
    return joins.segment_of(points, segs, "t", ["track", "idx"]).select("track", "idx", "seg_start")


@query(f"""WITH {_KNOTS}, g AS (SELECT track, idx * 1.0::DOUBLE AS a, idx + 4.0::DOUBLE AS b FROM s WHERE idx % 10 = 0)
SELECT pt.track, pt.idx, CASE WHEN count(g.a) = 0 THEN any_value(t) END AS t FROM pt LEFT JOIN g ON g.track = pt.track AND t > a AND t < b GROUP BY pt.track, pt.idx""")
def gap_masking(spark, sf_dir):
    s = user_series(spark, sf_dir)
    _, points = _knots(spark, sf_dir)
    gaps = s.where("idx % 10 = 0").select("track", F.col("idx").cast("double").alias("gap_start"), (F.col("idx") + 4.0).alias("gap_end"))
    return joins.outside_gaps(points.withColumn("u", F.col("t")), gaps, "u", "t", 10.0, ["track", "idx"]).select("track", "idx", "t")


_PCHIP = f"""{_KNOTS}, nb AS (SELECT track, x, y, x - lag(x) OVER w AS hb, lead(x) OVER w - x AS hf, lead(x, 2) OVER w - lead(x) OVER w AS hff, lag(x) OVER w - lag(x, 2) OVER w AS hbb,
 (y - lag(y) OVER w) / (x - lag(x) OVER w) AS db, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS df,
 (lead(y, 2) OVER w - lead(y) OVER w) / (lead(x, 2) OVER w - lead(x) OVER w) AS dff, (lag(y) OVER w - lag(y, 2) OVER w) / (lag(x) OVER w - lag(x, 2) OVER w) AS dbb FROM kn WINDOW w AS (PARTITION BY track ORDER BY x)),
en AS (SELECT *, CASE WHEN db IS NULL THEN ((2 * hf + hff) * df - hf * dff) / (hf + hff) WHEN df IS NULL THEN ((2 * hb + hbb) * db - hb * dbb) / (hb + hbb) END AS e FROM nb),
sl AS (SELECT track, x, y, CASE
  WHEN db IS NULL THEN CASE WHEN dff IS NULL THEN df WHEN sign(e) <> sign(df) THEN 0 WHEN sign(df) <> sign(dff) AND abs(e) > 3 * abs(df) THEN 3 * df ELSE e END
  WHEN df IS NULL THEN CASE WHEN dbb IS NULL THEN db WHEN sign(e) <> sign(db) THEN 0 WHEN sign(db) <> sign(dbb) AND abs(e) > 3 * abs(db) THEN 3 * db ELSE e END
  WHEN db * df <= 0 THEN 0 ELSE (3 * hf + 3 * hb) / ((2 * hf + hb) / db + (hf + 2 * hb) / df) END AS m FROM en),
p2 AS (SELECT * FROM (SELECT track, x AS x0, lead(x) OVER w AS x1, y AS y0, lead(y) OVER w AS y1, m AS m0, lead(m) OVER w AS m1 FROM sl WINDOW w AS (PARTITION BY track ORDER BY x)) WHERE x1 IS NOT NULL),
h2 AS (SELECT pt.track, idx, t, coalesce(arg_max(p2, x0) FILTER (x0 <= t), arg_min(p2, x0)) AS q FROM pt LEFT JOIN p2 ON pt.track = p2.track GROUP BY ALL),
cc AS (SELECT track, idx, q.x1 - q.x0 AS h, (t - q.x0) / (q.x1 - q.x0) AS u, (q.y1 - q.y0) / (q.x1 - q.x0) AS d, q.y0 AS y0, q.m0 AS m0, q.m1 AS m1 FROM h2)"""


@query(f"WITH {_PCHIP} SELECT track, idx, {M('y0 + h * u * (m0 + u * (3 * d - 2 * m0 - m1 + u * (m0 + m1 - 2 * d)))')} AS value, {M('m0 + u * (2 * (3 * d - 2 * m0 - m1) + 3 * u * (m0 + m1 - 2 * d))')} AS rate FROM cc")
def pchip_eval(spark, sf_dir):
    knots, points = _knots(spark, sf_dir)
    return joins.pchip_at(points, knots, "t", "x", "y").select("track", "idx", S.micro("value").alias("value"), S.micro("rate").alias("rate"))


@query(f"""WITH RECURSIVE {USER_SERIES_SQL}, p AS (SELECT track, t, y, row_number() OVER (PARTITION BY track ORDER BY t, y) AS i, count(*) OVER (PARTITION BY track) AS z FROM (SELECT track, idx * 1.5::DOUBLE + v % 7 / 10.0::DOUBLE AS t, v AS y FROM s)),
nx AS (SELECT a.track, a.i, min(b.i) AS j FROM p a JOIN p b ON b.track = a.track AND b.i > a.i AND b.t - a.t >= 4.0 GROUP BY a.track, a.i),
kd AS (SELECT track, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n FROM p WHERE i = 1 UNION ALL SELECT kd.track, nx.j, kd.n + 1 FROM kd JOIN nx ON nx.track = kd.track AND nx.i = kd.i),
en AS (SELECT track, max(n) AS top, max(i) AS tail FROM kd GROUP BY track), zz AS (SELECT DISTINCT track, z FROM p),
kp AS (SELECT kd.track, kd.i, kd.n FROM kd JOIN en USING (track) JOIN zz USING (track) JOIN p a ON a.track = kd.track AND a.i = tail JOIN p b ON b.track = kd.track AND b.i = zz.z WHERE NOT (kd.n = top AND top > 0 AND b.t > a.t)
 UNION ALL SELECT en.track, zz.z, CASE WHEN top > 0 THEN top ELSE 1 END FROM en JOIN zz USING (track) JOIN p a ON a.track = en.track AND a.i = tail JOIN p b ON b.track = en.track AND b.i = zz.z WHERE b.t > a.t)
SELECT kp.track, CAST(n AS INTEGER) AS n, {M('t')} AS t, y FROM kp JOIN p ON p.track = kp.track AND p.i = kp.i""")
def knot_decimation(spark, sf_dir):
    s = user_series(spark, sf_dir).select("track", (F.col("idx") * 1.5 + F.col("v") % 7 / 10).alias("t"), F.col("v").alias("y"))
    kept = series.decimated(s, "t", "y", 4.0)
    return kept.select("track", F.posexplode("knots").alias("n", "k")).select("track", "n", S.micro("k.t").alias("t"), "k.y")


@query(f"""WITH {TYPE_SERIES_SQL}, d AS (SELECT track, idx, lead(idx * idx + v) OVER (PARTITION BY track ORDER BY idx) - (idx * idx + v) AS step FROM s)
SELECT track, count(*) AS n, min(step) AS min_step, median(step) AS median_step, coalesce(bool_and(step > 0), true) AS rising FROM d GROUP BY track""")
def monotonicity_check(spark, sf_dir):
    s = type_series(spark, sf_dir).withColumn("y", F.col("idx") * F.col("idx") + F.col("v"))
    return series.monotonicity(s, "y", "idx", 0.0)


# Event time --------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "ts", F.rint(F.col("value") * 100).alias("v"))


@query(f"""WITH e AS (SELECT event_type AS track, round_even(value * 100, 0) AS v, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS b FROM events),
w AS (SELECT track, v, unnest([b - 1, b]) AS b FROM e) SELECT track, b * 7200.0::DOUBLE AS start_s, count(*) AS n, {M('sqrt(avg(v * v) + 1e-12::DOUBLE)')} AS energy FROM w GROUP BY track, b""")
def hopping_energy(spark, sf_dir):
    """Overlapping four-hour windows every two hours, as a stream would make them."""
    out = stream.hopping_energy(_events(spark, sf_dir), "4 hours", "2 hours")
    return out.select("track", F.unix_timestamp("start").cast("double").alias("start_s"), "n", S.micro("energy").alias("energy"))


@query("""WITH e AS (SELECT event_type AS track, epoch(ts) AS t FROM events), o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM o) SELECT track, floor(min(t)) AS start_s, floor(max(t) + 1800) AS end_s, count(*) AS n FROM g GROUP BY track, no""")
def session_activity(spark, sf_dir):
    """Active intervals ended by half an hour of silence."""
    out = stream.sessions(_events(spark, sf_dir), "30 minutes")
    return out.select("track", F.unix_timestamp("start").cast("double").alias("start_s"), F.unix_timestamp("end").cast("double").alias("end_s"), "n")


@query("SELECT event_id, floor(epoch(ts)) AS t FROM events")
def epoch_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.floor(epoch_seconds(F.col("ts"))).cast("double").alias("t"))
