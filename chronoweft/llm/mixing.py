"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by (source, language, topic) cell; the cells' sampling
probabilities are raked until the expected tokens meet the source, language and
topic marginals; documents are then drawn with their cell's probability by a
hash of their id.  Only the cells take part in the raking: on the driver while
there are at most :data:`MAX_CELLS` of them, as a loop of aggregates and joins
beyond that.

Topics are clusters of hashed-word vectors around their language's mean, fitted
on all texts from centres of a bounded sample, unless the documents have a topic column of their own.
Texts are read once; the rounds and the assignment read the table of vectors made then.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, fresh_all, hashed_sample, holding, release, small_batches, staged

#: Cells up to which raking runs on the driver and probabilities are broadcast.
MAX_CELLS = 100_000
#: Topics, hashed word dimensions, documents of the sample that the centres start from, k-means rounds.
TOPICS, DIMS, TOPIC_SAMPLE, TOPIC_ROUNDS = 8, 1024, 2000, 12
#: Targets of the registered query: each marginal's share to this power, over
#: half of the tokens.
TEMPERATURE, KEEP_SHARE = 0.7, 0.5
ROUNDS, TOLERANCE, SEED = 100, 1e-6, 17
#: Vector values are summed in steps of one by this.
_STEPS = 2.0**24
MARGINS = ("source", "lang", "topic")


def _vector(words: list[bytes]) -> np.ndarray:
    """The unit vector of hashed word counts, damped by logarithms."""
    c = Counter(words)
    at = np.fromiter(map(zlib.crc32, c), np.int64, len(c)) % DIMS
    full = np.bincount(at, 1 + np.log(np.fromiter(c.values(), np.float64, len(c))), DIMS).astype(np.float32)
    return full / max(np.linalg.norm(full), np.float32(1e-12))


def _packed(z: np.ndarray) -> tuple[bytes, bytes]:
    """A bit for each slot, set where ``z`` is not zero, and the values there: plain bytes, which Spark moves as they are."""
    used = z != 0
    return np.packbits(used).tobytes(), z[used].tobytes()


def _dense(bits: list[bytes | None], values: list[bytes | None]) -> np.ndarray:
    """The vectors of :func:`_packed`, one a row; zero where there is none."""
    out = np.zeros((len(bits), DIMS), np.float32)
    used = np.unpackbits(np.frombuffer(b"".join(x or bytes(DIMS // 8) for x in bits), np.uint8)).view(bool)
    out[used.reshape(out.shape)] = np.frombuffer(b"".join(x or b"" for x in values), np.float32)
    return out


@dataclass
class Topics:
    """Centres of the topics and the languages' means (the key None: of all)."""

    centres: np.ndarray
    means: dict

    def of(self, z: np.ndarray, lang) -> int:
        return int(np.argmax(self.centres @ (z - self.means.get(lang, self.means[None]))))


def facts(docs: DataFrame, text: str, lang: str, vectors: bool = True, **also: Column) -> DataFrame:
    """(``also``, h, lang, n_tokens) of every row, and (s, w) with ``vectors``: all that is taken from the texts, in one pass.

    Tokens are words between ASCII white space; h is a hash of the text, (s, w)
    the text's vector by :func:`_packed`, null without a text.
    """
    small_batches(docs.sparkSession)
    t = F.col(text).cast("string")
    base = docs.select(
        *(c.alias(name) for name, c in also.items()), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), F.col(lang).cast("string").alias("lang"), t.alias("t")
    )
    schema = base.drop("t").schema.add("n_tokens", T.LongType())
    if vectors:
        schema = schema.add("s", T.BinaryType()).add("w", T.BinaryType())
    names = schema.names

    def run(batches):
        for b in batches:
            *given, t = b.columns
            words = [None if x is None else x.lower().split() for x in t.cast(pa.binary()).to_pylist()]
            columns = [*given, pa.array([len(x or ()) for x in words], pa.int64())]
            if vectors:
                made = [(None, None) if x is None else _packed(_vector(x)) for x in words]
                columns += [pa.array([x[i] for x in made], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, schema)


def placed(rows: DataFrame, topics: Topics) -> DataFrame:
    """``rows`` of :func:`facts` with the topic nearest to each vector, and without the vectors."""
    held = rows.sparkSession.sparkContext.broadcast(topics)
    schema = rows.drop("s", "w").schema.add("topic", T.IntegerType())
    names, at = schema.names, schema.names.index("lang")

    def run(batches):
        fitted = held.value
        for b in batches:
            *given, s, w = b.columns
            topic = [fitted.of(z, x) for z, x in zip(_dense(s.to_pylist(), w.to_pylist()), b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*given, pa.array(topic, pa.int32())], names=names)

    return rows.mapInArrow(run, schema)


def _centred(z: np.ndarray, langs: list, means: dict) -> np.ndarray:
    """Unit vectors of the differences from the languages' means."""
    z = z - np.stack([means.get(x, means[None]) for x in langs])
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return z / np.where(norm > 0, norm, 1)


def _totals(rows: DataFrame, made) -> dict:
    """{key: (n, sum)} over all ``rows`` (lang, s, w); ``made(langs, z)`` gives a batch's keys and vectors.

    Each task sums its rows, then each key's sums are added up, so the driver
    gets one row a key.  Values count in steps of 2**-24: such sums are exact,
    whatever their order.
    """

    def merge(held, key, n, total):
        before = held.get(key, (0, 0))
        held[key] = before[0] + n, before[1] + total

    def out(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())], names=["key", "n", "total"]
        )

    def part(batches):
        held = {}
        for b in batches:
            if b.num_rows:
                langs = b.column(0).to_pylist()
                keys, z = made(langs, _dense(b.column(1).to_pylist(), b.column(2).to_pylist()))
                names = list(dict.fromkeys(keys))
                number = {k: i for i, k in enumerate(names)}
                member = np.zeros((len(names), len(keys)))
                member[[number[k] for k in keys], np.arange(len(keys))] = 1
                sums = (member @ np.rint(z.astype(np.float64) * _STEPS)).astype(np.int64)
                for k, n, total in zip(names, member.sum(1).astype(int).tolist(), sums):
                    merge(held, k, n, total)
        yield out(held)

    def join(batches):
        held = {}
        for b in batches:
            for k, n, total in zip(*(b.column(i).to_pylist() for i in range(3))):
                merge(held, k, n, np.frombuffer(total, np.int64))
        yield out(held)

    kind = "key string, n long, total binary"
    got = rows.select("lang", "s", "w").mapInArrow(part, kind).repartition("key").mapInArrow(join, kind).collect()
    return {r.key: (r.n, np.frombuffer(bytes(r.total), np.int64) / _STEPS) for r in got}


def fit_topics(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS, sample: int = TOPIC_SAMPLE) -> Topics:
    """k-means by cosine over every text that is not null, around the means of all texts of its language.

    Only the first centres come from ``sample`` distinct texts, taken by the
    order of their hashes; each round then passes over all vectors.  Held on the
    driver and broadcast: one mean for each language, and the centres.
    """
    rows = staged(facts(docs, text, lang), "vectors")
    fitted = _fitted(rows, topics, sample)
    release(rows)
    return fitted


def _fitted(rows: DataFrame, topics: int = TOPICS, sample: int = TOPIC_SAMPLE) -> Topics:
    """:func:`fit_topics` from the rows of :func:`facts`, a table."""
    every = rows.where("s IS NOT NULL").select("lang", "h", "s", "w")
    sums = _totals(every, lambda langs, z: (langs, z))
    n = sum(x[0] for x in sums.values())
    if not n:
        return Topics(np.zeros((1, DIMS), np.float32), {None: np.zeros(DIMS, np.float32)})
    means = {k: (total / m).astype(np.float32) for k, (m, total) in sums.items() if k is not None}
    means[None] = (sum(total for _, total in sums.values()) / n).astype(np.float32)
    got = hashed_sample(every, F.col("h"), sample).toArrow()
    langs, z = got["lang"].to_pylist(), _dense(got["s"].to_pylist(), got["w"].to_pylist())
    order = np.lexsort((*z.T[:4], got["h"].to_numpy(), [str(x) for x in langs]))
    z = _centred(z[order], [langs[i] for i in order], means)
    centres = z[np.linspace(0, len(z) - 1, min(topics, len(z))).astype(int)].copy()
    for _ in range(TOPIC_ROUNDS):

        def nearest(langs, z, means=means, centres=centres):
            z = _centred(z, langs, means)
            return np.argmax(z @ centres.T, axis=1).astype(str).tolist(), z

        before, centres = centres, centres.copy()
        for k, (_, total) in _totals(every, nearest).items():
            centres[int(k)] = total / max(np.linalg.norm(total), 1e-12)
        if np.array_equal(before, centres):
            break
    return Topics(centres.astype(np.float32), means)


def tempered(shares: dict, power: float = TEMPERATURE) -> dict:
    """Target shares: each share to ``power``, then made to sum to one."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else {}


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], keep_share: float = KEEP_SHARE) -> np.ndarray:
    """Sampling probabilities of the cells.

    ``codes[m]`` numbers the cells' values of margin m and ``targets[m]`` are
    their target shares.  Every round scales the cells to each margin in turn
    and holds them at one at most, until no margin moves.
    """
    p = np.full(len(tokens), float(keep_share))
    budget = keep_share * tokens.sum()
    for _ in range(ROUNDS):
        before = p.copy()
        for code, share in zip(codes, targets):
            now = np.bincount(code, p * tokens, len(share))
            p = np.minimum(1.0, p * np.where(now > 0, share * budget / np.where(now > 0, now, 1), 1.0)[code])
        if np.abs(p - before).max(initial=0) < TOLERANCE:
            break
    return p


def _target(cells: DataFrame, margin: str, target: dict | float) -> DataFrame:
    """(margin, share): given shares, or the margin's own shares tempered by a power."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    if isinstance(target, dict):
        rows = [(k, float(v)) for k, v in target.items()]
        given = cells.sparkSession.createDataFrame(rows, T.StructType().add(margin, cells.schema[margin].dataType).add("raw", "double"))
        raw = sums.join(given, sums[margin].eqNullSafe(given[margin]), "left").select(sums[margin], F.coalesce("raw", F.lit(0.0)).alias("raw"))
    else:
        raw = sums.select(margin, F.when(F.col("n") > 0, F.pow("n", F.lit(float(target)))).otherwise(0.0).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(margin, (F.col("raw") / F.lit(total)).alias("share"))


def probabilities(cells: DataFrame, targets: dict, keep_share: float = KEEP_SHARE, max_cells: int = MAX_CELLS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``p``.

    ``targets`` has, for each margin, shares by value, or a power that tempers
    the margin's own shares.
    """
    shares = {m: _target(cells, m, targets[m]) for m in MARGINS}
    if cells.limit(max_cells + 1).count() <= max_cells:
        rows = sorted(cells.collect(), key=lambda r: [(r[m] is None, r[m] or 0) for m in MARGINS])
        codes, wanted = [], []
        for m in MARGINS:
            share = {r[0]: r[1] for r in shares[m].collect()}
            number = {v: i for i, v in enumerate(share)}
            codes.append(np.array([number[r[m]] for r in rows], np.int64))
            wanted.append(np.array(list(share.values())))
        p = rake(codes, np.array([r["tokens"] for r in rows], float), wanted, keep_share)
        made = [(*(r[m] for m in MARGINS), int(r["tokens"]), float(x)) for r, x in zip(rows, p)]
        return cells.sparkSession.createDataFrame(made, cells.select(*MARGINS, "tokens").schema.add("p", "double"))
    budget = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    now = staged(cells.select(*MARGINS, F.col("tokens").cast("long").alias("tokens")).withColumn("p", F.lit(float(keep_share))), "cells")
    shares = {m: staged(s, "target") for m, s in shares.items()}
    for _ in range(ROUNDS):
        step = now.withColumn("old", F.col("p"))
        for m in MARGINS:
            have = step.groupBy(F.col(m).alias("__m")).agg(F.sum(F.col("p") * F.col("tokens")).alias("have"))
            scale = have.join(shares[m], have["__m"].eqNullSafe(shares[m][m])).select(
                "__m", F.when(F.col("have") > 0, F.col("share") * budget / F.col("have")).otherwise(1.0).alias("scale")
            )
            step = step.join(scale, step[m].eqNullSafe(scale["__m"])).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("scale"))).drop("__m", "scale")
        nxt = staged(step, "cells")
        release(now)
        now = nxt
        if (now.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0] or 0) < TOLERANCE:
            break
    release(*shares.values())
    return holding(now.drop("old"), now)


def draw(id: Column, h: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id alone (on the text where the id is null)."""
    key = F.when(id.isNull(), F.xxhash64(h, F.lit(seed))).otherwise(F.xxhash64(id.cast("string"), F.lit(seed)))
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def mixed(
    docs: DataFrame,
    targets: dict | None = None,
    keep_share: float = KEEP_SHARE,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: str | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(id, h, source, lang, topic, n_tokens, probability, kept) for each row of ``docs``.

    Null sources and languages are values of their own; null and empty texts
    have no tokens and their cells' probability; rows that repeat an id are
    drawn together; an empty table gives an empty result.  Other columns are not
    read.  A target that the cells cannot meet at probability one is met as far
    as they go.
    """
    targets = targets or {m: TEMPERATURE for m in MARGINS}
    own = {"id": F.col(id), "source": F.col(source).cast("string")}
    if topic:
        rows = staged(facts(docs, text, lang, False, **own, topic=F.col(topic).cast("int")), "facts")
    else:
        read = staged(facts(docs, text, lang, **own), "vectors")
        rows = staged(placed(read, _fitted(read)), "facts")
        release(read)
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    cells = staged(cells, "cells")
    raked = p = probabilities(cells, targets, keep_share, max_cells)
    if cells.limit(max_cells + 1).count() <= max_cells:
        p = F.broadcast(p)  # at most max_cells short rows
    p = p.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("p").alias("probability"))
    on = [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    out = rows.join(p, on[0] & on[1] & on[2], "left").withColumn("kept", draw(F.col("id"), F.col("h")) < F.col("probability"))
    return holding(out.select(F.col("id").alias(id), "h", *MARGINS, "n_tokens", "probability", "kept"), rows, cells, raked)


def keep_mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns, of whatever names."""
    every = mixed(docs, id=id, text=text, **how)
    own, key, h = fresh_all(docs.columns, "id", "h", "text_hash")
    kept = every.where("kept").select(F.col(id).alias(own), F.col("h").alias(key)).distinct()
    on = F.col(id).eqNullSafe(F.col(own)) & (F.col(h) == F.col(key))
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return holding(rows.join(kept, on, "left_semi").select(*docs.columns), every)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every = mixed(docs)
    return holding(every.drop("h"), every)
