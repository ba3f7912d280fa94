"""Matching clips against a reference series by normalised correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AnchorMatching, OffsetSafety
from ..functions import scalar as S
from ..functions.signal import gcc_phat, ncc, peak_report, resample, resample_reach

PEAK = "struct<best_score:double,best_lag:bigint,second_score:double,second_lag:bigint,margin:double,prominence:double,width_samples:double,plateau_samples:double>"
#: Scores this close to the best count as equal; the earliest of them is taken.
NEAR_TIE = 1e-4
LEAST_SCORE = 0.10
#: Peaks of one anchor that are tried until one lies where the reference is active.
CANDIDATE_PEAKS = 5
#: Reasons of the reference's activity.
LOW_OVERLAP, NO_OVERLAP, UNAVAILABLE = "master_vad_low_overlap_ratio", "master_vad_no_overlap", "master_vad_unavailable"


def centred(a: Column) -> Column:
    """An array less its mean, scaled to length one unless it is flat."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    moved = F.transform(a, lambda x: x - mean)
    norm = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-12, F.transform(moved, lambda x: x / norm)).otherwise(moved)


def lag_scores(pairs: DataFrame, search: str, feature: str, keep: list[str]) -> DataFrame:
    """(keep, lag, score): correlation of short arrays at every lag, as rows, without Python.

    The pairs' arrays stay in their rows; only the scores are exploded.
    """
    f, s = F.col("__f"), F.col("__s")
    base = pairs.select(*keep, F.col(search).cast("array<double>").alias("__s"), centred(F.col(feature).cast("array<double>")).alias("__f"))
    # a feature that centring could not scale is flat
    flat = F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x) < 0.5
    lags = F.when(F.size(s) >= F.size(f), F.sequence(F.lit(0), F.size(s) - F.size(f))).otherwise(F.array().cast("array<int>"))
    cut = base.select(*keep, "__s", "__f", flat.alias("__flat"), F.explode(lags).alias("lag"))
    window = cut.withColumn("__w", F.slice("__s", F.col("lag") + 1, F.size("__f")))
    top = F.aggregate(F.zip_with("__w", "__f", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("__w", F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate("__w", F.lit(0.0), lambda a, x: a + x * x)
    width = F.sqrt(F.greatest(square - total * total / F.size("__f"), F.lit(0.0)))
    score = F.when(F.col("__flat") | (width <= 1e-12), -1.0).otherwise(top / width)
    return window.select(*keep, F.col("lag").cast("long").alias("lag"), score.alias("score"))


def best_lag(scores: DataFrame, key: list[str]) -> DataFrame:
    """(key, score, lag): the best score, and the earliest lag that comes near it."""
    best = scores.groupBy(*key).agg(F.max("score").alias("best"))
    near = scores.join(best, key).where(F.col("score") >= F.col("best") - NEAR_TIE)
    return near.groupBy(*key).agg(F.first("best").alias("score"), F.min("lag").alias("lag"))


def second_peak(scores: DataFrame, key: list[str], exclusion: int) -> DataFrame:
    """(key, best_lag, best_score, second_lag, second_score, margin): best peak, and the best
    other peak more than ``exclusion`` lags away; the ends count as peaks."""
    w = Window.partitionBy(*key).orderBy("lag")
    x = F.col("score")
    before, after = F.lag("score").over(w), F.lead("score").over(w)
    peaks = scores.withColumn("__p", before.isNull() | after.isNull() | ((x > before) & (x > after))).where("__p").drop("__p")
    best = peaks.groupBy(*key).agg(F.max(F.struct(F.col("score"), (-F.col("lag")).alias("back"))).alias("b"))
    best = best.select(*key, F.col("b.score").alias("best_score"), (-F.col("b.back")).alias("best_lag"))
    other = peaks.join(best, key).where(F.abs(F.col("lag") - F.col("best_lag")) > exclusion)
    second = other.groupBy(*key).agg(F.max(F.struct(F.col("score"), (-F.col("lag")).alias("back"))).alias("b"))
    second = second.select(*key, F.col("b.score").alias("second_score"), (-F.col("b.back")).alias("second_lag"))
    return best.join(second, key, "left").withColumn("margin", F.col("best_score") - F.col("second_score"))


def chunked(samples: DataFrame, size: int, track: str = "track") -> DataFrame:
    """(track, chunk, values): a series as arrays of ``size`` samples, numbered from 0."""
    at = F.floor(F.col("idx") / F.lit(size)).cast("long")
    rows = samples.select(track, at.alias("chunk"), F.struct("idx", F.col("v").cast("double").alias("v")).alias("s"))
    return rows.groupBy(track, "chunk").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("values"))


def resampled(chunks: DataFrame, size: int, source: int, target: int, track: str = "track") -> DataFrame:
    """(track, chunk, first, values): chunks of ``size`` samples at another rate, ``first`` being the number of a
    chunk's first sample.  Each chunk gets what the filter needs of its neighbours, and no more travels."""
    reach = resample_reach(source, target)
    edge = lambda part, step, name: chunks.select(track, (F.col("chunk") + step).alias("chunk"), part.alias(name))
    tail = F.slice("values", F.greatest(F.size("values") - reach + 1, F.lit(1)), F.lit(max(reach, 1)))
    rows = chunks.join(edge(tail, 1, "before"), [track, "chunk"], "left").join(edge(F.slice("values", F.lit(1), F.lit(max(reach, 1))), -1, "after"), [track, "chunk"], "left")

    @F.pandas_udf("struct<first:bigint,values:array<double>>")
    def run(chunk: pd.Series, before: pd.Series, own: pd.Series, after: pd.Series) -> pd.DataFrame:
        none, out = np.empty(0), []
        for k, b, x, z in zip(chunk, before, own, after):
            b, z = (none if v is None else v for v in (b, z))
            i = int(k) * size
            first, made = resample(np.concatenate((b, x, z)), source, target, (i - len(b), i, i + len(x)))
            out.append((first, np.asarray(made, float)))
        return pd.DataFrame(out, columns=["first", "values"])

    made = rows.select(track, "chunk", run("chunk", "before", "values", "after").alias("r"))
    return made.select(track, "chunk", "r.first", "r.values")


def windows(chunks: DataFrame, asked: DataFrame, size: int, key: list[str], track: str = "track", out: str = "samples") -> DataFrame:
    """``asked`` (i0, i1 inclusive) with the samples of each span and ``first``, the position of the first one.

    A request meets the chunks it touches by their numbers; its samples are
    bounded by its own length.
    """
    touched = F.sequence(F.floor(F.greatest(F.col("i0"), F.lit(0)) / F.lit(size)).cast("long"), F.floor(F.greatest(F.col("i1"), F.lit(0)) / F.lit(size)).cast("long"))
    spread = asked.where("i1 >= 0 AND i1 >= i0").select(*key, track, "i0", "i1", F.explode(touched).alias("chunk"))
    c = chunks.withColumnRenamed(track, "__track").withColumnRenamed("chunk", "__chunk")
    met = spread.join(c, (F.col(track) == F.col("__track")) & (F.col("chunk") == F.col("__chunk")))
    lists = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "values"))).alias("p"), F.first("i0").alias("a"), F.first("i1").alias("b"))
    first = F.greatest(F.col("a"), F.lit(0))
    start = F.element_at("p", 1)["chunk"] * size
    flat = F.flatten(F.transform("p", lambda x: x["values"]))
    cut = F.slice(flat, (first - start + 1).cast("int"), (F.col("b") - first + 1).cast("int"))
    return asked.join(lists.select(*key, first.alias("first"), cut.alias(out)), key, "left")


def peaks_udf(exclusion: int):
    """Column function (search, feature) -> the peak report of their correlation."""

    @F.pandas_udf(PEAK)
    def report(search: pd.Series, feature: pd.Series) -> pd.DataFrame:
        rows = []
        for s, f in zip(search, feature):
            got = None if s is None or f is None else peak_report(ncc(s, f), exclusion)
            rows.append(got or {})
        names = [part.split(":")[0] for part in PEAK[7:-1].split(",")]
        frame = pd.DataFrame(rows, columns=names)
        for n in ("best_lag", "second_lag"):
            frame[n] = frame[n].astype("Int64")
        return frame

    return report


def successive_peaks(scores: np.ndarray, exclusion: int, most: int, least: float) -> list[dict]:
    """Peak reports, best first: each of what is left once the surroundings of those before are wiped out.

    The first is there whatever its score, the others from ``least`` on.
    """
    x, out = np.array(scores, np.float64), []
    while len(out) < most and (p := peak_report(x, exclusion)) is not None and (not out or p["best_score"] >= least):
        out.append(p)
        x[max(0, p["best_lag"] - exclusion) : p["best_lag"] + exclusion + 1] = -1.0
    return out


def candidate_peaks_udf(exclusion: int, most: int, least: float):
    """Column function (search, feature) -> array of the peak reports that may be tried in turn."""

    @F.pandas_udf(f"array<{PEAK}>")
    def report(search: pd.Series, feature: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or f is None else successive_peaks(ncc(s, f), exclusion, most, least) for s, f in zip(search, feature)], dtype=object)

    return report


@F.pandas_udf(T.StructType([T.StructField("peak", T.DoubleType()), T.StructField("lag", T.LongType())]))
def phase_udf(search: pd.Series, feature: pd.Series) -> pd.DataFrame:
    out = []
    for s, f in zip(search, feature):
        g = gcc_phat(s, f) if s is not None and f is not None else np.empty(0)
        out.append((float(g.max()), int(g.argmax())) if g.size else (None, None))
    frame = pd.DataFrame(out, columns=["peak", "lag"])
    frame["lag"] = frame["lag"].astype("Int64")
    return frame


def padded(active: DataFrame, padding: float) -> DataFrame:
    """(ref, r_start, r_end): the reference's intervals (start, end), padded and merged."""
    from .series import merged

    wide = active.select(F.lit(0).alias("ref"), (F.col("start") - padding).alias("start"), (F.col("end") + padding).alias("end"))
    return merged(wide, "ref").select("ref", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def first_active(tried: DataFrame, solid: DataFrame, least_ratio: float, key: list[str]) -> DataFrame:
    """(key, rank, reason): of the places tried (rank from 0, master_start, master_end) the first one of which
    ``least_ratio`` lies in the intervals ``solid`` (of :func:`padded`); the first of all, with a reason, if there is none."""
    from .joins import overlap_ratio

    asked = tried.select(*key, "rank", F.lit(0).alias("ref"), F.col("master_start").alias("l_start"), F.col("master_end").alias("l_end"))
    rated = overlap_ratio(asked, solid, 60.0, [*key, "rank"], "ref")
    r = F.col("overlap_ratio")
    best = rated.groupBy(*key).agg(F.min(F.when(r >= least_ratio, F.col("rank"))).alias("hit"), F.max(F.when(F.col("rank") == 0, r)).alias("first"))
    reason = F.when(F.col("hit").isNull(), F.when(F.col("first") > 0, LOW_OVERLAP).otherwise(NO_OVERLAP))
    return best.select(*key, F.coalesce("hit", F.lit(0)).alias("rank"), reason.alias("reason"))


def match(pairs: DataFrame, sample_rate: float, cfg: AnchorMatching, keep: list[str], active: DataFrame | None = None, safety: OffsetSafety | None = None, stage=lambda df: df) -> DataFrame:
    """Anchors (clip, search, search_first, local_start, local_end, anchor_confidence) matched.

    Gives the place on the reference, all peak figures, the confidence and the
    reason of a rejection.  With the reference's ``active`` intervals the next
    best peaks are tried in turn until one lies there; an anchor with none loses
    its confidence.  ``stage`` writes what is read twice then.  The second
    correlation runs on the ambiguous rows only.
    """
    exclusion = max(1, int(np.rint(cfg.nms_exclusion_seconds * sample_rate)))
    most = 1 if active is None else CANDIDATE_PEAKS
    rate = F.lit(float(sample_rate))
    rated = pairs.where(F.size("search") >= F.size("clip")).withColumn("tried", candidate_peaks_udf(exclusion, most, cfg.ncc_min_score)("search", "clip"))
    unsure = lambda p: S.is_ambiguous(p["best_score"], p["margin"], p["prominence"], cfg) if cfg.gcc_phat_only_when_ambiguous else F.lit(True)
    rated = rated.withColumn("unsure", F.exists("tried", unsure) & F.lit(cfg.gcc_phat_enabled))
    second = rated.where("unsure").withColumn("g", phase_udf("search", "clip"))
    rated = rated.where("NOT coalesce(unsure, false)").withColumn("g", F.lit(None).cast("struct<peak:double,lag:bigint>")).unionByName(second)
    rows = rated.select(*keep, "local_start", "local_end", "anchor_confidence", "search_first", F.size("clip").alias("clip_size"), "tried", "g")
    place = (F.col("search_first") + F.col("p.best_lag")) / rate
    if active is None:
        rows = rows.withColumn("p", F.get("tried", F.lit(0))).withColumn("reason", F.lit(None).cast("string"))
    else:
        rows = stage(rows)
        spans = rows.select(*keep, "search_first", "clip_size", F.posexplode("tried").alias("rank", "p")).select(*keep, "rank", place.alias("master_start"), (place + F.col("clip_size") / rate).alias("master_end"))
        choice = first_active(spans, padded(active, safety.master_vad_padding_seconds), safety.master_vad_min_overlap_ratio, keep)
        rows = rows.join(choice, keep, "left").withColumn("p", F.get("tried", F.coalesce("rank", F.lit(0))))
    rows = rows.withColumn("g", F.when(unsure(F.col("p")), F.col("g")))
    best, margin, prom = F.col("p.best_score"), F.col("p.margin"), F.col("p.prominence")
    gap = (F.col("g.lag") - F.col("p.best_lag")) / rate
    agree = S.agreement("g.peak", gap, cfg)
    q, u, w = S.peak_quality(best, cfg), S.peak_uniqueness(margin, prom, cfg), S.peak_sharpness("p.width_samples", sample_rate, cfg)
    inactive = F.col("reason").isNotNull()
    out = rows.select(
        *keep, "local_start", "local_end",
        place.alias("master_start"),
        (place + F.col("clip_size") / rate).alias("master_end"),
        (place - F.col("local_start")).alias("offset_seconds"),
        best.alias("score"),
        *(F.col(f"p.{c}").alias(f"ncc_{c}") for c in ("second_score", "margin", "prominence", "width_samples", "plateau_samples")),
        F.col("g.peak").alias("gcc_phat_peak"), gap.alias("gcc_phat_gap_seconds"),
        q.alias("match_quality"), u.alias("match_uniqueness"), w.alias("match_sharpness"), agree.alias("match_agreement"),
        F.when(inactive, 0.0).otherwise(S.match_confidence("anchor_confidence", q, u, w, agree)).alias("confidence"),
        S.gate_reason(best, margin, prom, cfg).alias("gate"), "reason",
    )
    weak = F.when(F.col("confidence") < cfg.min_confidence_for_fit, "confidence_below_min_for_fit")
    return out.withColumn("rejected_reason", F.coalesce("reason", "gate", weak)).drop("gate", "reason")


def unmatched(asked: DataFrame, master_total: str, keep: list[str]) -> DataFrame:
    """Anchors (local_start, local_end, expected, clip_seconds) as matches that nothing vouches for: the reference's
    activity is unknown and such anchors are to be rejected.  Places are held within the reference."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.col(master_total), c))
    start = held(F.col("expected"))
    none = [f"ncc_{c}" for c in ("second_score", "margin", "prominence", "width_samples")] + ["gcc_phat_peak", "gcc_phat_gap_seconds", "match_quality", "match_uniqueness", "match_sharpness", "match_agreement"]
    return asked.select(
        *keep, "local_start", "local_end", start.alias("master_start"), held(F.col("expected") + F.col("clip_seconds")).alias("master_end"), (start - F.col("local_start")).alias("offset_seconds"),
        F.lit(0.0).alias("score"), *(F.lit(None).cast("double").alias(c) for c in none), F.lit(None).cast("long").alias("ncc_plateau_samples"), F.lit(0.0).alias("confidence"), F.lit(UNAVAILABLE).alias("rejected_reason"),
    )


def block_scores(sample_block: pd.Series, clip: pd.Series) -> pd.DataFrame:
    """For each block and clip: the best score and all lags that come near it."""
    out = []
    for s, c in zip(sample_block, clip):
        x = ncc(s, c) if s is not None and c is not None else np.empty(0)
        if not x.size:
            out.append((None, None))
            continue
        at = np.flatnonzero(x >= x.max() - NEAR_TIE)
        out.append((float(x.max()), [(int(i), float(x[i])) for i in at]))
    return pd.DataFrame(out, columns=["best", "near"])


def initial_offsets(clips: DataFrame, reference: DataFrame, sample_rate: float, track: str = "track") -> DataFrame:
    """(track, offset_seconds, confidence, score, local_start, master_start): the best anchor's place on the whole reference.

    ``clips``: (track, anchor_id, clip, local_start, confidence); ``reference``:
    (block, first, samples), blocks that overlap by the longest clip less one, so
    every lag is in one of them.  Anchors and blocks meet as rows; each result is
    a few numbers, and maxima reduce them.  Of anchors that score alike the
    first in order of ``anchor_id`` counts.
    """
    near_type = "struct<best:double,near:array<struct<lag:bigint,score:double>>>"
    blocks = reference.agg(F.max("block")).first()[0]
    if blocks is None:
        blocks = -1
    every = F.sequence(F.lit(0), F.lit(blocks)) if blocks >= 0 else F.array().cast("array<int>")
    spread = clips.withColumn("block", F.explode(every))
    rated = spread.join(reference.select("block", "first", "samples"), "block")
    rated = rated.select(track, "anchor_id", "local_start", "confidence", "first", F.pandas_udf(block_scores, near_type)("samples", "clip").alias("n"))
    best = rated.groupBy(track, "anchor_id", "local_start", "confidence").agg(F.max("n.best").alias("best"))
    places = rated.select(track, "anchor_id", "first", F.explode("n.near").alias("p")).join(best, [track, "anchor_id"])
    early = places.where(F.col("p.score") >= F.col("best") - NEAR_TIE).groupBy(track, "anchor_id", "local_start", "confidence", "best")
    early = early.agg(F.min(F.col("first") + F.col("p.lag")).alias("lag"))
    score, lag = F.col("best"), F.col("lag")
    one = early.where(score >= LEAST_SCORE).select(
        track, "anchor_id", "local_start", score.alias("score"), (lag / F.lit(float(sample_rate))).alias("master_start"), S.offset_confidence(score, "confidence").alias("confidence")
    )
    step = F.struct("anchor_id", "score", "confidence", "local_start", "master_start")
    ordered = one.groupBy(track).agg(F.array_sort(F.collect_list(step)).alias("a"))
    # a later anchor wins only if it is better by more than the tolerance
    win = F.aggregate(F.slice("a", 2, F.size("a")), F.element_at("a", 1), lambda w, x: F.when(x["score"] > w["score"] + NEAR_TIE, x).otherwise(w))
    return ordered.select(track, win.alias("w")).select(track, (F.col("w.master_start") - F.col("w.local_start")).alias("offset_seconds"), "w.confidence", "w.score", "w.local_start", "w.master_start")
