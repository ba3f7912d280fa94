"""Substring dedup over sliding spans of sentences.

Every run of several consecutive sentences is covered by hashes: from each
sentence the shortest run onwards, and to each sentence the shortest run up to
it, that has ``min_sentences`` sentences and ``min_words`` words.  A longer run
that repeats is the union of such runs, so nothing of it stays.  With
``min_words`` zero every pair of neighbouring sentences counts; the default
leaves alone what short sentences share by chance (without it, twice as many
documents of the test tables are touched).  A sentence of ``long_words`` words is
a run by itself: passages often come without a sentence's end.  Runs are joined globally by hash; all but the first
occurrence, by document id and place, are repeated, and the sentences that a
repeated run covers are removed.

The first occurrence of a hash comes from an aggregate that combines before it
shuffles, and only hashes that occur more than once reach the join, whose hot
keys AQE can split: no task gathers the occurrences of a passage.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_all, holding, release, small_batches, staged

MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 20, 50
_END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|\s*\n\s*")


def sentences(text: str) -> list[str]:
    """Slices that make up the whole text, each a sentence and the white space after it."""
    cuts = [m.end() for m in _END.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    out, at = [], 0
    for c in cuts:
        if c > at:
            out.append(text[at:c])
            at = c
    return out


def runs(parts: list[str], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, str]]:
    """(first sentence, last sentence, normalised text) of every run to hash."""
    words = [p.lower().split() for p in parts]
    sizes = [len(w) for w in words]
    n = len(parts)
    total = np.concatenate(([0], np.cumsum(sizes))).tolist()
    found = set()
    j = 0
    for i in range(n):  # shortest run onwards
        if not sizes[i]:
            continue
        j = max(j, i + min_sentences - 1)
        while j < n and total[j + 1] - total[i] < min_words:
            j += 1
        if j < n:
            found.add((i, j))
        if sizes[i] >= long_words:
            found.add((i, i))
    i = n - 1
    for j in range(n - 1, -1, -1):  # shortest run up to
        if not sizes[j]:
            continue
        i = min(i, j - min_sentences + 1)
        while i >= 0 and total[j + 1] - total[i] < min_words:
            i -= 1
        if i >= 0:
            found.add((i, j))
    flat = [" ".join(w) for w in words]
    return [(i, j, " ".join(flat[i : j + 1])) for i, j in sorted(found)]


def hashed_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, h, first, last, h1, h2) of every run that ``how`` (see :func:`runs`) asks for; ``h`` is the hash of the whole text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    schema = base.drop("t").schema
    for n, kind in (("first", T.IntegerType()), ("last", T.IntegerType()), ("h1", T.LongType()), ("h2", T.IntegerType())):
        schema = schema.add(n, kind)

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            row, first, last, made = [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                found = runs(sentences(t), **how)
                row.append(len(found))
                first += [f for f, _, _ in found]
                last += [e for _, e, _ in found]
                made += [digest(s.encode("utf-8", "surrogatepass"))[:12] for _, _, s in found]
            at = pa.array(np.repeat(np.arange(len(row)), row))
            raw = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 12)
            h1 = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
            h2 = np.ascontiguousarray(raw[:, 8:]).view("<i4").ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h1), pa.array(h2)],
                names=["id", "h", "first", "last", "h1", "h2"],
            )

    return base.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, h, spans) of the documents with repeated runs; spans are (first, last) sentence numbers.

    Texts are cut and hashed once: the runs are a table of numbers.
    """
    every = staged(hashed_runs(docs, id, text, **how), "runs")
    # a null id comes after all others
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "first")
    shared = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n")
    shared = staged(shared, "shared")
    later = every.join(shared, ["h1", "h2"]).where(~place.eqNullSafe(F.col("origin")))
    spans = staged(later.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")), "spans")
    release(every, shared)
    return spans


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Every row of ``docs``, its text without repeated sentences, and the columns
    ``n_sentences``, ``n_removed`` and ``removed`` (start:end of the removed runs
    of characters in the old text, code points, comma-joined).

    Null texts stay null, with no sentences; empty texts have none.  Rows that
    repeat both id and text are one document: they are treated alike, and count
    as one place.  Ties go to the smaller id, then to the hash of the text, then
    to the earlier place; a null id comes last.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns
    found = repeated_spans(docs, id, text, **how)
    names = fresh_all(keep, "n_sentences", "n_removed", "removed")
    own, key, h, cut = fresh_all([*keep, *names], "id", "key", "h", "spans")
    spans = found.select(F.col("id").alias(own), F.col("h").alias(key), F.col("spans").alias(cut))
    both = docs.withColumn(h, F.xxhash64(F.col(text).cast("string")))
    both = both.join(spans, F.col(id).eqNullSafe(F.col(own)) & (F.col(h) == F.col(key)), "left")
    schema = T.StructType([T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema])
    for n, kind in zip(names, (T.IntegerType(), T.IntegerType(), T.StringType())):
        schema = schema.add(n, kind)
    where = keep.index(text)

    def run(batches):
        for b in batches:
            texts, total, gone, removed = [], [], [], []
            for t, s in zip(b.column(where).to_pylist(), b.column(len(keep)).to_pylist()):
                parts = sentences(t or "")
                total.append(len(parts))
                drop = np.zeros(len(parts), bool)
                for r in s or []:
                    drop[r["first"] : r["last"] + 1] = True
                gone.append(int(drop.sum()))
                if gone[-1]:
                    t = "".join(p for p, d in zip(parts, drop) if not d)
                texts.append(t)
                ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(int) if gone[-1] else np.zeros(1, int)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(int), [0]))))
                removed.append(",".join(f"{ends[x]}:{ends[y]}" for x, y in zip(edge[::2], edge[1::2])))
            columns = [pa.array(texts, pa.string()) if i == where else b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(removed, pa.string())], names=[*keep, *names])

    cols = [F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in keep]
    return holding(both.select(*cols, cut).mapInArrow(run, schema), found)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed, and the text that is left, of every document."""
    made = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return holding(made.select("doc_id", "n_sentences", "n_removed", "removed", "text"), made)
