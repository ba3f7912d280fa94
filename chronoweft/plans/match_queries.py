"""Queries: correlation of short vectors, peaks, gates, confidences, offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import AnchorMatching, OffsetSafety
from ..functions import scalar as S
from ..operators import correlate
from ..operators.series import numbered
from ..sources.tables import table
from .activity_queries import M
from .registry import query

MATCH, SAFE = AnchorMatching(), OffsetSafety()

_LAGS = """f AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
pr AS (SELECT f.vec_id, f, s FROM f JOIN t ON t.vec_id = f.vec_id + 1), c AS (SELECT vec_id, s, list_transform(f, lambda x: x - list_avg(f)) AS f FROM pr),
l AS (SELECT vec_id, f, s, unnest(range(len(s) - 15)) AS lag FROM c), w AS (SELECT vec_id, lag, f, s[lag + 1:lag + 16] AS w FROM l),
sc AS (SELECT vec_id, lag, list_dot_product(w, f) / sqrt(list_dot_product(f, f)) / sqrt(list_dot_product(w, w) - list_sum(w) * list_sum(w) / 16) AS score FROM w)"""


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = e.select("vec_id", F.slice("embedding", 1, 16).alias("feature"))
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("search"))
    return correlate.lag_scores(f.join(t, "vec_id"), "search", "feature", ["vec_id"])


@query(f"WITH {_LAGS} SELECT vec_id, lag, {M('score')} AS score FROM sc")
def ncc_lags(spark, sf_dir):
    """Each vector's head sought in the vector after it, at every lag."""
    return _scores(spark, sf_dir).withColumn("score", S.micro("score"))


@query(f"WITH {_LAGS}, b AS (SELECT vec_id, max(score) AS best FROM sc GROUP BY vec_id) SELECT vec_id, {M('best')} AS score, min(lag) AS lag FROM sc JOIN b USING (vec_id) WHERE score >= best - 1e-4 GROUP BY vec_id, best")
def ncc_best(spark, sf_dir):
    return correlate.best_lag(_scores(spark, sf_dir), ["vec_id"]).withColumn("score", S.micro("score"))


@query(f"""WITH {_LAGS}, nb AS (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS n FROM sc WINDOW w AS (PARTITION BY vec_id ORDER BY lag)), pk AS (SELECT * FROM nb WHERE p IS NULL OR n IS NULL OR (score > p AND score > n)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, lag) AS k FROM pk), b AS (SELECT vec_id, score AS best_score, lag AS best_lag FROM r WHERE k = 1),
o AS (SELECT r.vec_id, r.score, r.lag, row_number() OVER (PARTITION BY r.vec_id ORDER BY r.score DESC, r.lag) AS k FROM r JOIN b USING (vec_id) WHERE abs(r.lag - best_lag) > 3)
SELECT b.vec_id, {M('best_score')} AS best_score, best_lag, {M('o.score')} AS second_score, o.lag AS second_lag, {M('best_score - o.score')} AS margin FROM b LEFT JOIN o ON o.vec_id = b.vec_id AND o.k = 1""")
def ncc_second_peak(spark, sf_dir):
    out = correlate.second_peak(_scores(spark, sf_dir), ["vec_id"], 3)
    return out.select("vec_id", S.micro("best_score").alias("best_score"), "best_lag", S.micro("second_score").alias("second_score"), "second_lag", S.micro("margin").alias("margin"))


# Peaks as figures: a line item stands for a peak ----------------------------------

_PEAKS = """pk AS (SELECT l_orderkey, l_linenumber, (l_partkey % 101) / 100.0::DOUBLE AS best, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE (l_partkey % 29) / 100.0::DOUBLE END AS margin,
 (l_suppkey % 23) / 100.0::DOUBLE AS prominence, (l_partkey % 17) * 50.0::DOUBLE AS width, l_quantity / 50.0::DOUBLE AS anchor, CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey % 13) / 100.0::DOUBLE END AS peak, (l_partkey % 120 - 60) / 1000.0::DOUBLE AS gap FROM lineitem)"""
_GATE = "CASE WHEN best < 0.45 THEN 'ncc_best_score_below_min' WHEN margin < 0.10 THEN 'ncc_margin_below_min' WHEN prominence < 0.06 THEN 'ncc_prominence_below_min' END"


def _ramp(x: str, low: float, high: float) -> str:
    return f"greatest(0, least(1, ({x} - {low}::DOUBLE) / {high - low!r}::DOUBLE))"


_UNIQUE = f"""CASE WHEN margin IS NULL THEN {_ramp('prominence', 0.03, 0.15)} ELSE least(CASE WHEN prominence >= 0.15 THEN {_ramp('margin', 0.05 * 0.4, 0.20)} ELSE {_ramp('margin', 0.05, 0.20)} END, {_ramp('prominence', 0.03, 0.15)}) END"""
_AGREE = "CASE WHEN peak IS NULL THEN 1.0::DOUBLE WHEN peak >= 0.05 AND abs(gap) <= 0.09 THEN greatest(0, least(1, 1 - abs(gap) / 0.03::DOUBLE)) ELSE 0.0::DOUBLE END"


def _peaks(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ((p % 101) / 100.0).alias("best"), F.when(s % 7 != 0, (p % 29) / 100.0).alias("margin"), ((s % 23) / 100.0).alias("prominence"), ((p % 17) * 50.0).alias("width"),
        (F.col("l_quantity") / 50.0).alias("anchor"), F.when(s % 3 == 0, (p % 13) / 100.0).alias("peak"), ((p % 120 - 60) / 1000.0).alias("gap"),
    )


@query(f"""WITH {_PEAKS}, q AS (SELECT *, {_ramp('best', 0.45, 1.0)} AS quality, {_UNIQUE} AS uniqueness, 1 - {_ramp('width / 16000.0::DOUBLE', 0.005, 0.050)} AS sharpness, {_AGREE} AS agreement FROM pk)
SELECT l_orderkey, l_linenumber, {M('quality')} AS quality, {M('uniqueness')} AS uniqueness, {M('sharpness')} AS sharpness, {M('agreement')} AS agreement, {M('greatest(0, least(1, anchor * quality * uniqueness * sharpness * agreement))')} AS confidence FROM q""")
def confidence_components(spark, sf_dir):
    q = _peaks(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "anchor", S.peak_quality("best", MATCH).alias("quality"), S.peak_uniqueness("margin", "prominence", MATCH).alias("uniqueness"),
        S.peak_sharpness("width", 16000, MATCH).alias("sharpness"), S.agreement("peak", "gap", MATCH).alias("agreement"),
    )
    made = S.match_confidence("anchor", "quality", "uniqueness", "sharpness", "agreement")
    return q.select("l_orderkey", "l_linenumber", *(S.micro(c).alias(c) for c in ("quality", "uniqueness", "sharpness", "agreement")), S.micro(made).alias("confidence"))


@query(f"""WITH {_PEAKS} SELECT {_GATE} AS reason, ({_GATE} IS NOT NULL OR coalesce(margin < 0.2 AND prominence < 0.3, false) OR prominence < 0.12) AS ambiguous, count(*) AS n FROM pk GROUP BY ALL""")
def hard_gate(spark, sf_dir):
    p = _peaks(spark, sf_dir)
    return p.groupBy(S.gate_reason("best", "margin", "prominence", MATCH).alias("reason"), S.is_ambiguous("best", "margin", "prominence", MATCH).alias("ambiguous")).agg(F.count("*").alias("n"))


_OFFSETS = """o AS (SELECT o_orderkey, (o_custkey % 101) / 100.0::DOUBLE AS confidence, o_orderkey % 5 = 0 AS fallback, (o_orderkey % 89) / 88.0::DOUBLE AS fb, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE (o_orderkey % 31) / 100.0::DOUBLE END AS margin FROM orders),
b AS (SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.25 THEN 'low' ELSE 'failed' END AS band FROM o)"""


_D = "format('{{:.3f}}', round_even(({}) * 1000, 0) / 1000)".format


def _offsets(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(k, ((c % 101) / 100.0).alias("confidence"), (k % 5 == 0).alias("fallback"), ((k % 89) / 88.0).alias("fb"), F.when(c % 4 != 0, (k % 31) / 100.0).alias("margin"))
    return o.withColumn("band", S.confidence_band("confidence", SAFE))


@query(f"""WITH {_OFFSETS} SELECT o_orderkey, band, CASE band WHEN 'high' THEN 6.0::DOUBLE WHEN 'medium' THEN 12.0::DOUBLE WHEN 'low' THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS radius,
CASE WHEN band = 'failed' THEN 'no_usable_initial_estimate' WHEN fallback THEN band || '_confidence_fallback_selected' WHEN band = 'low' THEN 'low_confidence_no_fallback_selected' ELSE band || '_confidence_anchor_estimate' END AS reason FROM b""")
def offset_band_radius(spark, sf_dir):
    o = _offsets(spark, sf_dir)
    r = S.search_radius("band", "fallback", F.col("band") != "failed", SAFE)
    return o.withColumn("r", r).select("o_orderkey", "band", "r.radius", "r.reason")


@query(f"""WITH {_OFFSETS} SELECT o_orderkey, (fb >= 0.5 AND coalesce(margin >= 0.10, true) AND (fb - confidence >= 0.15 OR band = 'failed')) AS accepted,
concat_ws('; ', CASE WHEN fb < 0.5 THEN 'confidence ' || {_D('fb')} || ' is below 0.500' END, CASE WHEN margin < 0.10 THEN 'peak margin ' || {_D('margin')} || ' is below 0.100' END,
 CASE WHEN fb - confidence < 0.15 THEN 'gain over the anchors ' || {_D('fb - confidence')} || ' is below 0.150' END) AS objections FROM b""")
def fallback_gate(spark, sf_dir):
    o = _offsets(spark, sf_dir)
    return o.select("o_orderkey", S.fallback_accepted("fb", "margin", "confidence", SAFE).alias("accepted"), S.fallback_objections("fb", "margin", "confidence", SAFE).alias("objections"))


@query("""SELECT o_orderkey, CASE WHEN 699.05 < greatest(o_totalprice / 200, 300) THEN floor(44739242 / 64000.0::DOUBLE * 1e6 + 0.5) / 1e6 END AS cap, 44739242 / 64000.0::DOUBLE < greatest(o_totalprice / 200, 300) AS memory_limited FROM orders""")
def fallback_cap(spark, sf_dir):
    """Seconds that a memory budget leaves to the whole-recording correlation."""
    c = S.fallback_cap(F.col("o_totalprice") / 200, F.lit(300.0), SAFE)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", S.micro("c.cap").alias("cap"), "c.memory_limited")


@query(f"""WITH {_LAGS}, nb AS (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS n FROM sc WINDOW w AS (PARTITION BY vec_id ORDER BY lag)), pk AS (SELECT * FROM nb WHERE p IS NULL OR n IS NULL OR (score > p AND score > n)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, lag) AS k FROM pk), b AS (SELECT vec_id, score AS best, lag AS bl FROM r WHERE k = 1),
o AS (SELECT r.vec_id, max(r.score) AS second FROM r JOIN b ON b.vec_id = r.vec_id WHERE abs(r.lag - bl) > 3 GROUP BY r.vec_id),
m AS (SELECT sc.vec_id, best, bl, max(lag) AS top, min(score) FILTER (lag <= bl) AS lm, min(score) FILTER (lag >= bl) AS rm, min(score) AS mn FROM sc JOIN b ON b.vec_id = sc.vec_id GROUP BY ALL),
h AS (SELECT *, bl > 0 AND bl < top AS inside, CASE WHEN bl > 0 AND bl < top THEN best - greatest(lm, rm) ELSE best - mn END AS prom FROM m), v AS (SELECT *, best - prom / 2 AS level FROM h),
lc AS (SELECT v.vec_id, max(nb.lag) AS a FROM v JOIN nb ON nb.vec_id = v.vec_id AND nb.lag < bl AND score < level GROUP BY v.vec_id), rc AS (SELECT v.vec_id, min(nb.lag) AS a FROM v JOIN nb ON nb.vec_id = v.vec_id AND nb.lag > bl AND score < level GROUP BY v.vec_id),
wd AS (SELECT v.*, coalesce(bl - x.lag - (level - x.score) / (x.n - x.score), bl) AS lw, coalesce(y.lag - bl - (level - y.score) / (y.p - y.score), top - bl) AS rw FROM v LEFT JOIN lc ON lc.vec_id = v.vec_id LEFT JOIN nb x ON x.vec_id = v.vec_id AND x.lag = lc.a LEFT JOIN rc ON rc.vec_id = v.vec_id LEFT JOIN nb y ON y.vec_id = v.vec_id AND y.lag = rc.a)
SELECT wd.vec_id, bl AS best_lag, {M('best')} AS best_score, {M('best - second')} AS margin, {M('prom')} AS prominence, {M('CASE WHEN inside AND prom > 0 THEN lw + rw ELSE 0 END')} AS width_samples FROM wd LEFT JOIN o ON o.vec_id = wd.vec_id""")
def peak_prominence(spark, sf_dir):
    """Best peak of the vectors' correlations with height, prominence and width, on the numeric kernels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("clip")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("search")), "vec_id")
    p = pairs.select("vec_id", correlate.peaks_udf(3)("search", "clip").alias("p"))
    return p.select("vec_id", "p.best_lag", *(S.micro(f"p.{c}").alias(c) for c in ("best_score", "margin", "prominence", "width_samples")))


_PAIRS = """f AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), t AS (SELECT vec_id - 1 AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), pr AS (SELECT f.vec_id, f, s FROM f JOIN t USING (vec_id)),
fx AS (SELECT vec_id, unnest(f) AS x, unnest(range(len(f))) AS j FROM pr), sx AS (SELECT vec_id, unnest(s) AS x, unnest(range(len(s))) AS j FROM pr), bins AS (SELECT unnest(range(128)) AS q)"""


@query(f"""WITH {_PAIRS}, ff AS (SELECT vec_id, q, sum(x * cos(2 * pi() * q * j / 128)) AS re, -sum(x * sin(2 * pi() * q * j / 128)) AS im FROM fx, bins GROUP BY ALL), sf AS (SELECT vec_id, q, sum(x * cos(2 * pi() * q * j / 128)) AS re, -sum(x * sin(2 * pi() * q * j / 128)) AS im FROM sx, bins GROUP BY ALL),
cr AS (SELECT vec_id, q, sf.re * ff.re + sf.im * ff.im AS re, sf.im * ff.re - sf.re * ff.im AS im FROM sf JOIN ff USING (vec_id, q)), nm AS (SELECT vec_id, q, re / greatest(sqrt(re * re + im * im), 1e-8::DOUBLE) AS re, im / greatest(sqrt(re * re + im * im), 1e-8::DOUBLE) AS im FROM cr),
lg AS (SELECT vec_id, lag, sum(re * cos(2 * pi() * q * lag / 128) - im * sin(2 * pi() * q * lag / 128)) / 128 AS g FROM nm, (SELECT unnest(range(49)) AS lag) GROUP BY ALL)
SELECT vec_id, {M('max(g)')} AS peak, arg_max(lag, g) AS lag FROM lg GROUP BY vec_id""")
def gcc_phat(spark, sf_dir):
    """Best lag of the phase correlation of the same pairs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("clip")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("search")), "vec_id")
    g = pairs.select("vec_id", correlate.phase_udf("search", "clip").alias("g"))
    return g.select("vec_id", S.micro("g.peak").alias("peak"), "g.lag")




_TRIED = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS copy FROM lineitem),
tr AS (SELECT l_orderkey, l_linenumber, copy, rank, (l_partkey * 7 + rank * 131) % 9000 / 10.0::DOUBLE AS x, (l_partkey * 7 + rank * 131) % 9000 / 10.0::DOUBLE + 1 + l_quantity / 25.0::DOUBLE AS y FROM a, (SELECT CAST(unnest(range(5)) AS INTEGER) AS rank)),
iv AS (SELECT idx * 3.0::DOUBLE AS a, idx * 3.0::DOUBLE + 0.4 + v / 5000.0::DOUBLE AS b FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_partkey % 13 * 100 AS v FROM part) WHERE idx * 3 < 1000),
op AS (SELECT a - 0.25 AS a, b + 0.25 AS b, CASE WHEN a - 0.25 <= max(b + 0.25) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM iv), me AS (SELECT min(a) AS a, max(b) AS b FROM (SELECT *, sum(o) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM op) GROUP BY g),
ov AS (SELECT l_orderkey, l_linenumber, copy, rank, least(1, coalesce(sum(CASE WHEN a IS NOT NULL THEN least(y, b) - greatest(x, a) END), 0) / any_value(y - x)) AS r FROM tr LEFT JOIN me ON x < b AND a < y GROUP BY ALL)"""


@query(f"""WITH {_TRIED}, h AS (SELECT l_orderkey, l_linenumber, copy, min(rank) FILTER (r >= 0.25) AS hit, max(r) FILTER (rank = 0) AS first FROM ov GROUP BY ALL)
SELECT l_orderkey, l_linenumber, copy, coalesce(hit, 0) AS rank, CASE WHEN hit IS NULL THEN CASE WHEN first > 0 THEN 'master_vad_low_overlap_ratio' ELSE 'master_vad_no_overlap' END END AS reason FROM h""")
def first_active_peak(spark, sf_dir):
    """Five places for every line item; the first one where the reference (here: parts) is active counts."""
    key = ["l_orderkey", "l_linenumber", "copy"]
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", copy.cast("long").alias("copy"))
    at = (F.col("l_partkey") * 7 + F.col("rank") * 131) % 9000 / 10.0
    tried = a.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(*key, "rank", at.alias("master_start"), (at + 1.0 + F.col("l_quantity") / 25.0).alias("master_end"))
    p = numbered(table(spark, sf_dir, "part").select(F.lit(0).alias("track"), "p_partkey", (F.col("p_partkey") % 13 * 100).alias("v")), "track", ["p_partkey"]).where("idx * 3 < 1000")
    active = p.select((F.col("idx") * 3.0).alias("start"), (F.col("idx") * 3.0 + 0.4 + F.col("v") / 5000.0).alias("end"))
    return correlate.first_active(tried, correlate.padded(active, 0.25), 0.25, key)
