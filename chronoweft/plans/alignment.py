"""The whole alignment of many local series to one reference.

Every stage is a DataFrame over all tracks at once, written as a table where
later stages read it more than once.  Stages: activity, anchors, initial offset with a coarse fallback,
matching around it, time maps, rendering, issues.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnchorMatching, AnchorSelection, DriftModel, OffsetSafety
from ..functions import scalar as S
from ..functions.signal import ncc, peak_report
from ..sources.staging import removed, written
from ..operators import activity, anchors, correlate, drift, local_adjust, nonlinear, render, report, series

from .progress import Progress

#: Samples of a chunk of a series, and of a block of the reference.
CHUNK, BLOCK = 16_384, 262_144
#: Seconds that a clip must have to be matched.
LEAST_CLIP = 0.5


@dataclass(frozen=True)
class Options:
    sample_rate: int = 16_000
    strategy: str = "adaptive_rms"
    selection: AnchorSelection = field(default_factory=AnchorSelection)
    matching: AnchorMatching = field(default_factory=AnchorMatching)
    safety: OffsetSafety = field(default_factory=OffsetSafety)
    drift: DriftModel = field(default_factory=DriftModel)
    local_adjust: bool = False
    #: A line this far from rate one is only rendered if ``accept_stretch``.
    stretch_warning: float = 0.003
    accept_stretch: bool = False
    #: How samples are placed: ``resample``, a registered stretcher, or a method that follows a time map.
    stretch_method: str = "resample"
    verbose: bool = False
    language: str = "en"


@dataclass
class Alignment:
    """The stages' results.  Those that later stages read are tables by now; the rest is lazy."""

    segments: DataFrame
    anchors: DataFrame
    offsets: DataFrame
    matches: DataFrame
    models: DataFrame
    selected: DataFrame
    rendered: DataFrame
    issues: DataFrame
    render_info: DataFrame
    regions: DataFrame
    reports: DataFrame
    document: DataFrame
    kept: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Remove the stages' tables; nothing can be read from the results after it."""
        for path in self.kept:
            removed(self.segments.sparkSession, path)


COARSE = "track {}, offset_seconds double, confidence double, score double, margin double"


def coarse_offset(a: np.ndarray, b: np.ndarray, rate: int) -> tuple:
    """(offset, confidence, score, margin) of a whole recording ``a`` on a reference ``b``; nulls if they don't match."""
    if a.size < 2 or b.size < 2:
        return (None,) * 4
    a, b = a - a.mean(), b - b.mean()
    n, least = a.size, max(1, a.size // 4)
    scores = ncc(np.concatenate((np.zeros(n - 1), b, np.zeros(n - least))), a)
    lag = np.arange(scores.size) - (n - 1)
    common = np.minimum(n, b.size - lag) - np.maximum(0, -lag)
    p = peak_report(np.where(common >= least, scores, -1.0), max(1, int(np.rint(0.05 * rate))))
    if p is None or p["best_score"] < correlate.LEAST_SCORE:
        return (None,) * 4
    margin = p["prominence"] if p["margin"] is None else p["margin"]
    return float(lag[p["best_lag"]]) / rate, min(1.0, max(0.0, (p["best_score"] + 1) / 2)), p["best_score"], margin


def _coarse(asked: DataFrame, chunks: DataFrame, ref_chunks: DataFrame, rate: int, low: int, keep) -> DataFrame:
    """The coarse offset of every track of ``asked`` (track, local_seconds, master_seconds: how much to use), one at a time.

    Chunks are resampled where they lie; only the low rate is put together.
    """
    small = F.floor(F.col("chunk") * CHUNK / F.lit(float(rate)))  # seconds before a chunk
    local = correlate.resampled(chunks.join(asked.select("track", "local_seconds"), "track").where(small <= F.col("local_seconds")).select("track", "chunk", "values"), CHUNK, rate, low)
    ref = keep(correlate.resampled(ref_chunks, CHUNK, rate, low))
    last = F.floor(F.col("master_seconds") * F.lit(float(rate)) / CHUNK).cast("long")
    wanted = asked.select("track", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    both = local.withColumn("side", F.lit(0)).unionByName(wanted.join(ref.drop("track"), "chunk").withColumn("side", F.lit(1)))
    rows = both.join(asked, "track").select("track", "side", "first", "values", "local_seconds", "master_seconds")
    kind = asked.schema["track"].dataType

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("first", "ascending")])
        side = table["side"].to_numpy()
        parts = table["values"].combine_chunks()
        n = [int(table[c][0].as_py() * low) for c in ("local_seconds", "master_seconds")]
        a, b = (np.asarray(parts.filter(pa.array(side == k)).flatten().to_numpy(zero_copy_only=False))[: n[k]] for k in (0, 1))
        made = coarse_offset(a, b, low)
        names = ["offset_seconds", "confidence", "score", "margin"]
        return pa.table({"track": table["track"].slice(0, 1).combine_chunks(), **{c: pa.array([v], pa.float64()) for c, v in zip(names, made)}})

    return rows.groupBy("track").applyInArrow(run, COARSE.format(kind.simpleString()))


def _safe_offsets(estimates: DataFrame, tracks: DataFrame, chunks: DataFrame, ref_chunks: DataFrame, rate: int, cfg: OffsetSafety, keep) -> DataFrame:
    """Anchor estimates, replaced by the coarse ones where these are more reliable; with band, radius and flags.

    Only tracks whose anchor estimate is weak take part in the fallback.
    """
    base = tracks.join(estimates.select("track", F.col("offset_seconds").alias("a_offset"), F.col("confidence").alias("a_confidence")), "track", "left")
    base = keep(base.withColumn("known", F.coalesce("a_confidence", F.lit(0.0))))
    known = F.col("known")
    weak = base.where(F.lit(cfg.coarse_fallback_enabled) & (known < cfg.initial_offset_min_confidence))
    cap = S.fallback_cap("total", "master_total", cfg)
    used = lambda total: F.least(F.col(total), F.coalesce("cap.cap", F.col(total)))
    asked = keep(weak.withColumn("cap", cap).select("track", "cap", used("total").alias("local_seconds"), used("master_total").alias("master_seconds")))
    found = _coarse(asked.drop("cap"), chunks, ref_chunks, rate, min(rate, cfg.coarse_fallback_sample_rate), keep)
    tried = found.select("track", F.struct("offset_seconds", "confidence", "score", "margin").alias("c"))
    both = base.join(tried.join(asked.select("track", F.col("cap.memory_limited").alias("limited")), "track"), "track", "left")
    accepted = F.coalesce(S.fallback_accepted("c.confidence", "c.margin", known, cfg), F.lit(False))
    both = keep(both.withColumn("fallback_selected", accepted))
    confidence = F.when(F.col("fallback_selected"), F.col("c.confidence")).otherwise(known)
    both = both.withColumn("confidence", confidence).withColumn("offset_seconds", F.when(F.col("fallback_selected"), F.col("c.offset_seconds")).otherwise(F.coalesce("a_offset", "c.offset_seconds")))
    both = keep(both.withColumn("band", S.confidence_band("confidence", cfg)))
    usable = (F.col("band") != "failed") & (F.col("fallback_selected") | F.col("a_offset").isNotNull())
    both = keep(both.withColumn("r", S.search_radius("band", "fallback_selected", usable, cfg)))
    attempted = F.lit(cfg.coarse_fallback_enabled) & (known < cfg.initial_offset_min_confidence)
    flags = F.array(
        F.when(attempted & F.col("c.offset_seconds").isNull(), "coarse_offset_fallback_failed_or_ambiguous"),
        F.when(attempted & F.col("c.offset_seconds").isNotNull() & ~F.col("fallback_selected") & F.col("a_offset").isNotNull() & (S.confidence_band(known, cfg) != "failed"), "coarse_offset_fallback_attempted_but_rejected"),
        F.when(attempted & F.col("limited"), "coarse_fallback_memory_limited"),
        F.when(F.col("fallback_selected") & (F.abs(F.col("offset_seconds") - F.col("a_offset")) > 1.0) & (F.col("confidence") < cfg.high_confidence_threshold), "initial_offset_estimates_disagree"),
        F.when(F.col("band").isin("low", "failed"), "initial_offset_low_confidence"),
        F.when(F.col("fallback_selected"), "coarse_offset_fallback_used"),
        F.when(F.col("r.radius") > cfg.high_confidence_search_radius_seconds, "drift_search_radius_widened"),
    )
    return both.select("track", "total", "offset_seconds", "confidence", "band", "fallback_selected", F.col("r.radius").alias("radius"), F.col("r.reason").alias("radius_reason"), F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


#: Stages that report their end.
STAGES = ("activity", "anchors", "offsets", "matches", "models", "reports")


def align(samples: DataFrame, reference: DataFrame, options: Options | None = None, progress=None, event=None) -> Alignment:
    """Align every track of ``samples`` (track, idx, v) to ``reference`` (idx, v).

    ``progress(percent, seconds_left, stage)`` and ``event(line)`` are called as stages end.
    """
    o = options or Options()
    kept: list[str] = []
    steps = Progress(len(STAGES), progress, event)

    def keep(df: DataFrame) -> DataFrame:
        out, path = written(df, "align")
        kept.append(path)
        return out

    rate, key = o.sample_rate, ["track", "segment_id"]
    ref = reference.select(F.lit("ref").alias("track"), "idx", "v")
    totals = keep(samples.groupBy("track").agg(((F.max("idx") + 1) / F.lit(float(rate))).alias("total")))
    master_total = ref.agg(((F.max("idx") + 1) / F.lit(float(rate))).alias("master_total"))
    tracks = keep(totals.join(F.broadcast(master_total), F.lit(True)))  # one row of the reference
    segments = keep(activity.detect(samples, rate, o.strategy))
    steps.step("activity")
    candidates = keep(anchors.candidates(samples, segments, totals, rate, o.selection))
    chosen = keep(anchors.select(candidates, o.selection))
    steps.step("anchors")

    chunks, ref_chunks = keep(correlate.chunked(samples, CHUNK)), keep(correlate.chunked(ref, CHUNK))
    i0 = S.truncated(F.col("local_start") * rate)
    spans = chosen.select(*key, "local_start", "local_end", F.col("confidence").alias("anchor_confidence"), i0.alias("i0"), (S.truncated(F.col("local_end") * rate) - 1).alias("i1"))
    clips = correlate.windows(chunks, spans, CHUNK, key, out="clip").where(F.size("clip") >= int(LEAST_CLIP * rate))
    clips = keep(clips.select(*key, "local_start", "local_end", "anchor_confidence", "clip"))
    # blocks of the reference overlap by the longest clip, so that every lag lies in one
    over = int(np.ceil(o.selection.max_anchor_duration_seconds * rate)) + 1
    wanted = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("master_total") * rate - 1) / BLOCK).cast("long")))
    blocks = master_total.where("master_total > 0").select(F.lit("ref").alias("track"), wanted.alias("block")).withColumn("i0", F.col("block") * BLOCK).withColumn("i1", F.col("i0") + BLOCK + over - 2)
    blocks = correlate.windows(ref_chunks, blocks, CHUNK, ["block"]).select(F.col("block").cast("int").alias("block"), "first", "samples")
    ordered = clips.select("track", F.struct(-F.col("anchor_confidence"), "local_start", "segment_id").alias("anchor_id"), "clip", "local_start", F.col("anchor_confidence").alias("confidence"))
    estimates = keep(correlate.initial_offsets(ordered, keep(blocks), rate))
    offsets = keep(_safe_offsets(estimates, tracks, chunks, ref_chunks, rate, o.safety, keep))

    steps.step("offsets")
    near = clips.join(offsets.where("radius > 0").select("track", "offset_seconds", "radius"), "track")
    expected = F.col("local_start") + F.col("offset_seconds")
    near = near.withColumn("i0", F.greatest(F.lit(0), S.truncated((expected - F.col("radius")) * rate))).withColumn("i1", S.truncated((expected + F.col("radius")) * rate) + F.size("clip") - 1)
    active = keep(activity.detect(ref, rate, o.strategy))
    # an empty list is as good as none: activity may have been missed on a quiet reference
    filtered, heard = o.safety.master_vad_filter_enabled, not active.isEmpty()
    if filtered and not heard and o.safety.master_vad_uncertain_policy == "reject":
        asked = near.join(tracks.select("track", "master_total"), "track").withColumn("expected", expected).withColumn("clip_seconds", F.size("clip") / F.lit(float(rate)))
        matches = correlate.unmatched(asked, "master_total", key)
    else:
        near = near.withColumn("asker", F.col("track")).withColumn("track", F.lit("ref"))
        asked = correlate.windows(ref_chunks, near, CHUNK, ["asker", "segment_id"], out="search")
        pairs = asked.select(F.col("asker").alias("track"), "segment_id", "local_start", "local_end", "anchor_confidence", "clip", "search", F.col("first").alias("search_first"))
        matches = correlate.match(pairs, rate, o.matching, key, active if filtered and heard else None, o.safety, keep)
    matches = keep(matches.withColumnRenamed("segment_id", "match_id"))
    steps.step("matches")

    models, judged = map(keep, drift.fit_linear(matches, o.matching.min_confidence_for_fit))
    gaps = keep(drift.unsupported(judged, o.drift.max_anchor_gap_seconds))
    selected = keep(nonlinear.with_gaps(nonlinear.select_models(models, judged, o.drift, totals), gaps))
    judged = keep(nonlinear.remarked(judged, selected))
    steps.step("models")
    confirmed = models if o.accept_stretch else models.where(F.abs(F.col("stretch_ratio") - 1.0) <= o.stretch_warning)
    made = render.render(samples, selected.join(confirmed.select("track"), "track", "left_semi"), tracks, rate, o.stretch_method, stage=keep)
    rendered = made.samples
    adjust_issues = report.issues_of(models, 40, "warning", "LOCAL_ADJUST", "local_adjust disabled")
    if o.local_adjust:
        silence = series.complement(activity.detect(rendered.select("track", F.col("i").alias("idx"), "v"), rate, "rms"), tracks.select("track", F.col("master_total").alias("total")))
        found, missing = local_adjust.events(judged, silence)
        rendered = local_adjust.shifted(rendered.select("track", F.col("i").alias("idx"), "v"), found, rate).select("track", F.col("idx").alias("i"), "v")
        adjust_issues = report.issues_of(missing, 40, "warning", "LOCAL_ADJUST", F.col("message"))

    words = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    diag = drift.diagnostics(models, judged, totals)
    own = selected.select("track", F.explode("warnings").alias("w")).where(F.col("w") != nonlinear.GAP_CODE)
    fit = drift.fit_warnings(diag, gaps)
    sparse = anchors.coverage(candidates, chosen, totals, o.selection)
    rejected = matches.where(F.col("rejected_reason").startswith("master_vad")).groupBy("track").agg(F.count("*").alias("n"))
    silent = tracks.select("track").where(F.lit(filtered and not heard))
    issues = (
        report.model_issues(totals, selected)
        .unionByName(report.issues_of(own, 10, "warning", F.col("w"), words(F.col("w"))))
        .unionByName(report.issues_of(fit, 20, "warning", F.col("code"), words(F.col("code")), F.col("time_seconds")))
        .unionByName(report.issues_of(sparse, 30, "warning", F.col("code"), words(F.col("code")), F.col("time_seconds")))
        .unionByName(adjust_issues)
        .unionByName(report.safety_issues(offsets.select("track", F.explode("flags").alias("flag")), 50))
        .unionByName(report.issues_of(rejected, 60, "warning", "MASTER_VAD_ANCHOR_REJECTED", report.worded("warnings.master_vad_anchor_rejected", o.language, count=F.col("n"))))
        .unionByName(report.issues_of(silent, 70, "warning", "MASTER_VAD_NO_SPEECH_SEGMENTS", report.worded("warnings.master_vad_no_speech_segments", o.language)))
    )
    issues = keep(report.distinct_issues(issues))
    facts = tracks.join(report.counts(segments, "speech_segment_count"), "track", "left").join(report.counts(chosen, "anchor_count_selected"), "track", "left")
    facts = facts.join(offsets.select("track", F.struct("offset_seconds", "confidence", "band", "fallback_selected", "radius", "radius_reason").alias("initial_offset")), "track", "left")
    facts = facts.join(made.info.select("track", F.struct("render_method", "n", "min_step", "rising").alias("global_correction")), "track", "left")
    reports = keep(report.track_reports(facts, selected, judged, issues, made.regions, diag, o.verbose))
    analysis = {"sample_rate": rate, "channels": "mono", "language": o.language, "vad": o.strategy, "report_detail_level": "verbose" if o.verbose else "default", "verbose_report": o.verbose}
    if o.verbose:
        analysis["configuration_snapshot"] = {n: getattr(o, n).as_dict() for n in ("selection", "matching", "safety", "drift")}
    steps.step("reports")
    document = report.document(analysis, master_total, reports, issues)
    return Alignment(segments, chosen, offsets, judged, models, selected, rendered, issues, made.info, made.regions, reports, document, kept)
