"""Queries: frames, thresholds, active intervals, anchors and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AnchorSelection
from ..functions import scalar as S
from ..operators import activity, anchors, series
from ..sources.tables import TYPE_SERIES_SQL, USER_SERIES_SQL, table, type_series, user_series
from .registry import query

FRAME, HOP, LEAST, FULL, FIXED = 6, 2, 6.0, 1e4, 5000.0
M = "floor(({}) * 1e6 + 0.5) / 1e6".format

_FRAMES = f"""{USER_SERIES_SQL},
held AS (SELECT track, unnest(generate_series(CAST(greatest(0, ceil((idx - {FRAME - 1}) / {HOP}.0)) AS BIGINT), CAST(floor(idx / {HOP}.0) AS BIGINT))) AS frame, v FROM s),
e AS (SELECT track, frame, sqrt(sum(v * v) / {FRAME}.0 + 1e-12::DOUBLE) AS energy FROM held GROUP BY ALL HAVING count(*) = {FRAME})"""
_THRESHOLDS = f"""{_FRAMES},
floors AS (SELECT track, quantile_cont(energy, 0.2) AS noise_floor FROM e GROUP BY track),
quiet AS (SELECT e.*, noise_floor FROM e JOIN floors USING (track) WHERE energy <= noise_floor),
centre AS (SELECT track, median(energy) AS c FROM quiet GROUP BY track),
mads AS (SELECT track, median(abs(energy - c)) AS mad FROM quiet JOIN centre USING (track) GROUP BY track),
th AS (SELECT track, noise_floor, mad, greatest(1e-4::DOUBLE, noise_floor + CASE WHEN mad < 1e-3 THEN 0 ELSE mad END) AS threshold FROM floors JOIN mads USING (track))"""


def _segments_sql(cte: str, source: str) -> str:
    return f"""WITH {cte},
runs AS (SELECT track, frame, energy, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS run FROM {source} WHERE energy >= threshold)
SELECT track, min(frame) * {HOP}.0::DOUBLE AS start, max(frame) * {HOP}.0::DOUBLE + {HOP} AS "end", {M(f"greatest(0, least(1, avg(energy) / {FULL}))")} AS confidence
FROM runs GROUP BY track, run HAVING max(frame) * {HOP} + {HOP} - min(frame) * {HOP} >= {LEAST}"""


def _energies(spark, sf_dir):
    return series.frame_energy(user_series(spark, sf_dir), FRAME, HOP)


@query(f"WITH {_FRAMES} SELECT track, frame, frame * {HOP} AS start, {M('energy')} AS energy FROM e")
def frame_rms(spark, sf_dir):
    return _energies(spark, sf_dir).withColumn("energy", S.micro("energy"))


@query(f"""WITH {USER_SERIES_SQL}, w AS (SELECT track, idx, count(*) OVER f AS n, sum(v) OVER f AS a, sum(v * v) OVER f AS b FROM s WINDOW f AS (PARTITION BY track ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT track, idx, CASE WHEN n = 8 THEN a END AS sum_v, CASE WHEN n = 8 THEN b END AS sum_vv FROM w""")
def rolling_sums(spark, sf_dir):
    return series.rolling_sums(user_series(spark, sf_dir), 8).drop("v")


@query(f"WITH {_THRESHOLDS} SELECT track, {M('noise_floor')} AS noise_floor, {M('mad')} AS mad, {M('threshold')} AS threshold FROM th")
def adaptive_threshold(spark, sf_dir):
    th = activity.adaptive_threshold(_energies(spark, sf_dir))
    return th.select("track", *(S.micro(c).alias(c) for c in ("noise_floor", "mad", "threshold")))


@query(_segments_sql(f"{_THRESHOLDS}, j AS (SELECT e.*, threshold FROM e JOIN th USING (track))", "j"))
def active_segments(spark, sf_dir):
    """Active intervals of every user's series against its own noise level."""
    e = _energies(spark, sf_dir)
    judged = e.join(activity.adaptive_threshold(e).select("track", "threshold"), "track")
    return activity.segments(judged, HOP, 1.0, LEAST, FULL).withColumn("confidence", S.micro("confidence"))


@query(_segments_sql(f"{_FRAMES}, j AS (SELECT *, {FIXED} AS threshold FROM e)", "j"))
def fixed_segments(spark, sf_dir):
    judged = _energies(spark, sf_dir).withColumn("threshold", F.lit(FIXED))
    return activity.segments(judged, HOP, 1.0, LEAST, FULL).withColumn("confidence", S.micro("confidence"))


# Anchors ---------------------------------------------------------------------

_CFG = AnchorSelection()
_PART = "p AS (SELECT p_partkey, CASE WHEN p_size < 4 THEN NULL ELSE p_size * 0.7::DOUBLE END AS snr, (p_partkey % 97) / 96.0::DOUBLE AS flatness, 0.5::DOUBLE + (p_partkey % 23) * 0.4::DOUBLE AS available FROM part)"
_STRETCH = """greatest(CASE WHEN snr IS NULL OR snr >= 24 THEN 1.0::DOUBLE WHEN snr >= 12 THEN 1.0::DOUBLE + (24.0::DOUBLE - snr) / 12.0::DOUBLE * 0.5::DOUBLE
  WHEN snr >= 6 THEN 1.5::DOUBLE + (12.0::DOUBLE - snr) / 6.0::DOUBLE * 0.5::DOUBLE ELSE 2.0::DOUBLE END,
  CASE WHEN flatness <= 0.25 THEN 1.0::DOUBLE WHEN flatness <= 0.65 THEN 1.0::DOUBLE + (flatness - 0.25::DOUBLE) / 0.40::DOUBLE * 0.5::DOUBLE ELSE 2.0::DOUBLE END)"""


@query(f"""WITH {_PART}, q AS (SELECT *, greatest(1.0::DOUBLE, least(8.0::DOUBLE, 4.0::DOUBLE * {_STRETCH})) AS wanted FROM p)
SELECT p_partkey, CASE WHEN available < 1.0 THEN 'too_short' END AS rejection_reason, {M('wanted')} AS wanted,
 {M('''CASE WHEN snr < 6 THEN 0.65::DOUBLE WHEN snr < 12 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN flatness > 0.75 THEN 0.65::DOUBLE WHEN flatness > 0.45 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN least(available, wanted) < wanted THEN greatest(0.5::DOUBLE, least(available, wanted) / wanted) ELSE 1.0::DOUBLE END''')} AS scale FROM q""")
def anchor_duration_policy(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.when(F.col("p_size") >= 4, F.col("p_size") * F.lit(0.7)).alias("snr"), ((k % 97) / 96.0).alias("flatness"), (F.lit(0.5) + (k % 23) * F.lit(0.4)).alias("available"))
    return p.select(
        "p_partkey", S.anchor_rejection("available", "snr", "flatness", _CFG).alias("rejection_reason"), S.micro(S.requested_duration("snr", "flatness", _CFG)).alias("wanted"), S.micro(S.confidence_scale("available", "snr", "flatness", _CFG)).alias("scale")
    )


@query("""WITH t AS (SELECT o_orderkey, CAST(o_totalprice / 50 AS DOUBLE) AS duration FROM orders),
b AS (SELECT *, CAST(least(greatest(5, ceil(duration / 60.0::DOUBLE)), 120) AS INTEGER) AS budget FROM t)
SELECT o_orderkey, budget, CAST(greatest(1, least(budget, ceil(duration / 60.0::DOUBLE))) AS INTEGER) AS bins FROM b""")
def anchor_budget(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 50).alias("duration"))
    t = t.withColumn("budget", S.anchor_budget("duration", _CFG))
    return t.select("o_orderkey", "budget", S.bin_count("duration", "budget", _CFG).alias("bins"))


def _candidates(spark, sf_dir):
    """Candidates of the selection queries: a part is an anchor, a brand a track of 600 seconds."""
    p = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") * 37 % 5990) / 10.0
    return p.select(F.col("p_brand").alias("track"), F.col("p_partkey").alias("id"), start.alias("local_start"), (start + 1.0).alias("local_end"), F.col("p_retailprice").alias("confidence"), F.lit(12).alias("budget")).withColumn(
        "bin_index", S.bin_of((F.col("local_start") + F.col("local_end")) / 2, F.lit(600.0), F.lit(10))
    )


_CANDIDATES = """c AS (SELECT p_brand AS track, p_partkey AS id, (p_partkey * 37 % 5990) / 10.0::DOUBLE AS local_start, (p_partkey * 37 % 5990) / 10.0::DOUBLE + 1.0::DOUBLE AS local_end, p_retailprice AS confidence FROM part),
b AS (SELECT *, CAST(greatest(0, least(9, trunc((local_start + local_end) / 2 / 600.0::DOUBLE * 10))) AS INTEGER) AS bin_index FROM c),
r1 AS (SELECT *, row_number() OVER (PARTITION BY track, bin_index ORDER BY confidence DESC, id) AS bin_rank FROM b),
r2 AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY bin_rank <= 2 DESC, confidence DESC, id) AS pick FROM r1),
chosen AS (SELECT * FROM r2 WHERE pick <= 12)"""


def _chosen(spark, sf_dir):
    return anchors.stratified(_candidates(spark, sf_dir), [F.desc("confidence")], "id", F.ceil(F.col("budget") / 10))


def _extents(rows):
    return rows.select("track").distinct().withColumn("total", F.lit(600.0)).withColumn("bins", F.lit(10))


@query(f"WITH {_CANDIDATES} SELECT track, id, bin_index, CAST(pick AS INTEGER) AS pick FROM chosen")
def stratified_topk(spark, sf_dir):
    return _chosen(spark, sf_dir).select("track", "id", "bin_index", "pick")


@query(f"""WITH {_CANDIDATES}, grid AS (SELECT track, CAST(unnest(range(10)) AS INTEGER) AS bin_index FROM (SELECT DISTINCT track FROM c)),
x AS (SELECT track, bin_index, count(*) AS n FROM b GROUP BY ALL), y AS (SELECT track, bin_index, count(*) AS n FROM chosen GROUP BY ALL)
SELECT track, bin_index, bin_index * 60.0::DOUBLE AS start, CASE WHEN bin_index = 9 THEN 600.0::DOUBLE ELSE (bin_index + 1) * 60.0::DOUBLE END AS "end", coalesce(x.n, 0) AS candidates, coalesce(y.n, 0) AS selected
FROM grid LEFT JOIN x USING (track, bin_index) LEFT JOIN y USING (track, bin_index)""")
def bin_coverage(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return anchors.bin_coverage(c, _chosen(spark, sf_dir), _extents(c))


_SPANS = f"""{_CANDIDATES}, pts AS (SELECT track, (local_start + local_end) / 2 AS p, 0 AS kind FROM chosen UNION ALL SELECT DISTINCT track, 600.0::DOUBLE, 1 FROM c),
gaps AS (SELECT track, coalesce(lag(p) OVER w, 0.0::DOUBLE) AS l, greatest(0, p - coalesce(lag(p) OVER w, 0.0::DOUBLE)) AS gap FROM pts WINDOW w AS (PARTITION BY track ORDER BY p, kind))"""


@query(f"WITH {_SPANS} SELECT track, {M('max(gap)')} AS longest, {M('min(l) FILTER (gap > 100)')} AS first_large FROM gaps GROUP BY track")
def coverage_gap(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    points = _chosen(spark, sf_dir).withColumn("midpoint", (F.col("local_start") + F.col("local_end")) / 2)
    gaps = series.spans(points, _extents(c))
    return gaps.groupBy("track").agg(S.micro(F.max("gap")).alias("longest"), S.micro(F.min(F.when(F.col("gap") > 100, F.col("left")))).alias("first_large"))


@query(f"WITH {_SPANS} SELECT track, 'LONG_UNANCHORED_SPAN' AS code, {M('min(l)')} AS time_seconds FROM gaps WHERE gap > 300 GROUP BY track")
def coverage_warnings(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    chosen = _chosen(spark, sf_dir)
    gaps = series.spans(chosen.withColumn("midpoint", (F.col("local_start") + F.col("local_end")) / 2), _extents(c))
    w = anchors.coverage_warnings(anchors.bin_coverage(c, chosen, _extents(c)), gaps, _extents(c).select("track", "total"))
    return w.withColumn("time_seconds", S.micro("time_seconds"))


@query(f"""WITH {_CANDIDATES} SELECT track, count(*) AS n, {M('min(local_start)')} AS first_start, {M('median(local_start)')} AS middle, {M('max(local_end)')} AS last_end, count(DISTINCT bin_index) AS bins FROM chosen GROUP BY track""")
def selection_summary(spark, sf_dir):
    c = _chosen(spark, sf_dir)
    return c.groupBy("track").agg(F.count("*").alias("n"), S.micro(F.min("local_start")).alias("first_start"), S.micro(F.median("local_start")).alias("middle"), S.micro(F.max("local_end")).alias("last_end"), F.countDistinct("bin_index").alias("bins"))


_SNR = f"""{TYPE_SERIES_SQL}, kk AS (SELECT track, unnest(range(CAST(floor(max(idx) / 200) AS BIGINT) + 1)) AS k FROM s GROUP BY track), clips AS (SELECT track, k, k * 200.0::DOUBLE + 50 AS a, k * 200.0::DOUBLE + 90 AS b FROM kk),
j AS (SELECT clips.track, k, v, idx, a, b FROM clips JOIN s ON s.track = clips.track AND idx >= a - 1 AND idx < b + 1),
g AS (SELECT track, k, avg(v * v) FILTER (idx >= a AND idx < b) AS sig, avg(v * v) FILTER ((idx >= a - 1 AND idx < a) OR (idx >= b AND idx < b + 1)) AS noise FROM j GROUP BY ALL)"""


@query(f"WITH {_SNR} SELECT clips.track, clips.k, {M('CASE WHEN sig IS NOT NULL AND noise IS NOT NULL THEN 20 * log10(greatest(sqrt(sig + 1e-18::DOUBLE), 1e-9::DOUBLE) / greatest(sqrt(noise + 1e-18::DOUBLE), 1e-9::DOUBLE)) END')} AS snr_db FROM clips LEFT JOIN g ON g.track = clips.track AND g.k = clips.k")
def local_snr(spark, sf_dir):
    s = type_series(spark, sf_dir)
    return _snr(s, _every_clip(s))


def _every_clip(s):
    """(track, k): a clip for every 200 samples of each series."""
    return s.groupBy("track").agg(F.max("idx").alias("last")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 200))).alias("k"))


def _snr(s, clips):
    a, b = F.col("k") * 200.0 + 50, F.col("k") * 200.0 + 90
    clips = clips.select("track", "k", a.alias("clip_start"), b.alias("clip_end"), a.alias("context_start"), b.alias("context_end"))
    return anchors.local_snr(s, clips, 1.0, ["track", "k"]).select("track", "k", S.micro("snr_db").alias("snr_db"))


@query(f"""WITH {TYPE_SERIES_SQL}, x AS (SELECT track, idx // 200 AS k, idx % 200 AS j, v FROM s WHERE idx % 200 < 128), g AS (SELECT track, k, avg(v) AS m, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT x.track, x.k, j, v - m AS v, n FROM x JOIN g ON g.track = x.track AND g.k = x.k), b AS (SELECT track, k, unnest(range(1, n // 2 + 1)) AS q FROM g),
p AS (SELECT c.track, c.k, q, sum(v * cos(2 * pi() * q * j / n)) ** 2 + sum(v * sin(2 * pi() * q * j / n)) ** 2 + 1e-18::DOUBLE AS power FROM c JOIN b ON b.track = c.track AND b.k = c.k GROUP BY ALL),
f AS (SELECT track, k, exp(avg(ln(power))) / avg(power) AS f FROM p GROUP BY ALL), z AS (SELECT track, k, max(abs(v)) AS top FROM c GROUP BY ALL)
SELECT g.track, g.k, {M('CASE WHEN top = 0 OR f IS NULL THEN 1.0::DOUBLE ELSE greatest(0, least(1, f)) END')} AS spectral_flatness FROM g JOIN z ON z.track = g.track AND z.k = g.k LEFT JOIN f ON f.track = g.track AND f.k = g.k""")
def spectral_flatness(spark, sf_dir):
    s = type_series(spark, sf_dir)
    clips = _every_clip(s).select("track", "k", (F.col("k") * 200.0).alias("clip_start"), (F.col("k") * 200.0 + 128).alias("clip_end"))
    return anchors.flatness(s, clips, 1.0, ["track", "k"]).select("track", "k", S.micro("spectral_flatness").alias("spectral_flatness"))


@query()
def anchor_selection(spark, sf_dir):
    """The whole selection, from samples to chosen anchors, on the event types' series."""
    s = type_series(spark, sf_dir)
    found = activity.detect_adaptive(s, 10, 600.0, 200.0, 1000.0, full_energy=FULL)
    totals = s.groupBy("track").agg((F.count("*") / 10.0).alias("total"))
    rows = anchors.candidates(s, found, totals, 10.0, _CFG)
    return anchors.select(rows, _CFG).select("track", "local_start", "local_end", S.micro("confidence").alias("confidence"), "bin_index", "pick")
