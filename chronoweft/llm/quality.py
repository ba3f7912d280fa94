"""Quality by nearest-neighbour voting in a latent-semantic space.

The space and the neighbours come from a sample of labelled documents whose
size is a parameter (the classifier's training set, not a cap on what is
scored): their hashed term counts are weighted by inverse document frequency
and reduced by a truncated SVD.  The labelled vectors are a few megabytes,
bounded by the sample, and are broadcast; every document is then projected and
its exact cosines with all of them are computed as blocked matrix products.
The nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Bound of the labelled sample, half of it for each label where there are enough.
MAX_LABELLED = 4000
#: Term space, latent dimensions, voters, and the power that sharpens similarities.
DIMS, LATENT, NEIGHBOURS, SHARPNESS = 1 << 14, 48, 25, 4
THRESHOLD = 0.3
#: Rows of a block of the cosine products.
BLOCK = 256

#: Classes of the share of words that repeat the word before them.
_REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)

# Bytes to classes: A for capitals, a for other letters, 9 for digits.
_CLASS = bytearray(range(256))
for _b in range(256):
    if _b >= 0x80 or 97 <= _b <= 122:
        _CLASS[_b] = ord("a")
    elif 65 <= _b <= 90:
        _CLASS[_b] = ord("A")
    elif 48 <= _b <= 57:
        _CLASS[_b] = ord("9")
_CLASS = bytes(_CLASS)


def held_out(id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a whole text and their counts: lower-cased words, the
    words' shapes (runs of capitals, other letters, digits, each sign), and how
    often a word follows itself, in classes of its share of the text."""
    b = text or b""
    if not b.strip():
        return np.empty(0, np.int64), np.empty(0)
    words = b.lower().split()
    counts = Counter(words)
    again = sum(map(eq, words, words[1:]))
    shape = np.frombuffer(b.translate(_CLASS), np.uint8)
    shapes = Counter(shape[np.concatenate(([True], shape[1:] != shape[:-1]))].tobytes().split())
    for step in _REPEATS:
        if again >= step * len(words):
            shapes[b"again %g" % step] = again
    crc = zlib.crc32
    n = len(counts) + len(shapes)
    at = np.fromiter((crc(w) for w in counts), np.int64, len(counts)) % (DIMS - DIMS // 8)
    sh = np.fromiter((crc(w) for w in shapes), np.int64, len(shapes)) % (DIMS // 8) + (DIMS - DIMS // 8)
    at = np.concatenate((at, sh))
    c = np.fromiter((*counts.values(), *shapes.values()), np.float64, n)
    slot, where = np.unique(at, return_inverse=True)
    return slot, np.bincount(where, c)


@dataclass
class Space:
    """A fitted classifier: ``basis`` (DIMS x latent, inverse document frequencies
    multiplied in), the labelled unit vectors, their labels and voting weights."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]))
        for i, t in enumerate(texts):
            slot, c = terms(t)
            if len(slot):
                out[i] = (1 + np.log(c)) @ self.basis[slot]
        return unit(out)

    def score(self, z: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if len(self.labels) == 0:
            return np.full(len(z), self.prior)
        out = np.empty(len(z))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(z), BLOCK):
            sim = z[i : i + BLOCK] @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[near]
            total = w.sum(1)
            share = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[i : i + BLOCK] = np.where(total > 0, share, self.prior)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _times(slot: np.ndarray, value: np.ndarray, bounds: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows (``bounds`` of runs of slots and values) times a dense matrix."""
    out = np.zeros((len(bounds) - 1, right.shape[1]))
    for i in range(len(out)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out[i] = value[a:b] @ right[slot[a:b]]
    return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Space:
    """Fit on at most ``max_labelled`` labelled rows that are not held out.

    Rows are taken by the order of a hash of their id, so the sample doesn't
    depend on how the tables are dealt out.  Null ids, labels other than 0 and 1,
    and labels without a document are left aside.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id)))
    known = known.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y"), F.xxhash64(F.col(id).cast("string"), F.lit(7)).alias("__o"))
    tally = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    parts = []
    for y in (0, 1):
        room = max(max_labelled // 2, max_labelled - tally.get(1 - y, 0))
        parts.append(known.where(F.col("__y") == y).orderBy("__o", "__id").limit(room))
    sample = parts[0].unionByName(parts[1]).select("__id", "__y")
    # At most max_labelled rows of two numbers: bounded, so it may be broadcast.
    rows = docs.select(F.col(id).alias("__d"), F.col(text).cast("string").alias("__t"))
    rows = rows.join(F.broadcast(sample), F.col("__d") == F.col("__id")).select("__id", "__y", "__t")

    def count(batches):
        for b in batches:
            slots, counts = [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s, c = terms(t)
                slots.append(s.astype(np.int32))
                counts.append(c.astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                names=["id", "y", "s", "c"],
            )

    schema = T.StructType().add("id", T.StringType()).add("y", T.IntegerType()).add("s", T.ArrayType(T.IntegerType())).add("c", T.ArrayType(T.FloatType()))
    got = rows.mapInArrow(count, schema).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy()
    total = tally.get(0, 0) + tally.get(1, 0)
    prior = tally.get(1, 0) / total if total else 0.5
    if len(y) == 0:
        return Space(np.zeros((DIMS, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0), prior)
    lists = got["s"].combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    slot = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    value = 1 + np.log(got["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    idf = np.log((1 + len(y)) / (1 + np.bincount(slot, minlength=DIMS))) + 1
    value *= idf[slot]
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    value /= np.sqrt(np.bincount(row, value * value, minlength=len(y)))[row]
    basis = _right_vectors(slot, value, bounds, min(LATENT, len(y)))
    vectors = unit(_times(slot, value, bounds, basis))
    drawn = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = np.array([1 - prior, prior]) / np.where(drawn > 0, drawn, 1)
    weights = share[y] / share[y].mean()
    return Space(basis * idf[:, None], vectors, y.astype(float), weights, prior)


def _right_vectors(slot, value, bounds, k: int, passes: int = 4) -> np.ndarray:
    """The leading right singular vectors of a sparse matrix, by subspace iteration."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(slot, kind="stable")
    by_slot, columns = np.unique(slot[order], return_index=True)
    back = np.concatenate((columns, [len(slot)]))
    q = np.random.default_rng(1).standard_normal((DIMS, k + 8))
    for _ in range(passes):
        left, _ = np.linalg.qr(_times(slot, value, bounds, q))
        q = np.zeros((DIMS, left.shape[1]))
        q[by_slot] = _times(row[order], value[order], back, left)
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        q = u
    return q[:, :k]


def scored(docs: DataFrame, space: Space, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: ``id``) of every row, and ``held_out``, ``score``, ``predicted``.

    Scores lie in 0 to 1, higher for label 1.  Null, empty and blank texts, and
    texts of which no term is known, get the share of label 1 among the labels.
    Rows that repeat stay.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(space)
    keep = keep or [id]
    name = fresh(keep, "score")
    schema = docs.select(*keep).schema.add(name, T.DoubleType())

    def run(batches):
        fitted = held.value
        for b in batches:
            z = fitted.project(b.column(len(keep)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fitted.score(z))], names=[*keep, name])

    made = docs.select(*keep, F.col(text).cast("string").alias(fresh(keep, "text"))).mapInArrow(run, schema)
    out = [F.col(c) for c in keep]
    if id in keep:
        out.append(held_out(F.col(id)).alias(fresh([*keep, name], "held_out")))
    return made.select(*out, F.col(name), (F.col(name) >= THRESHOLD).cast("int").alias(fresh([*keep, name], "predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; one pass, no shuffle."""
    space = fit(docs, labels, id, text, **how)
    every = scored(docs, space, id, text, keep=docs.columns)
    flag = fresh([*docs.columns, fresh(docs.columns, "score")], "predicted")
    return every.where(F.col(flag) == 1).select(*docs.columns)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs.select("doc_id", "text"), labels))
