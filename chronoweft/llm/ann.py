"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised with a codebook of their own, so ``k``
centroids a half give ``k * k`` cells.  A query goes through the pairs of
centroids in order of their summed distances with a heap (Babenko and Lempitsky,
2012) until the cells hold the wanted share of the rows, and the rows of these
cells are ranked by their exact distances.

Cells are packed into blocks of bounded size (a cell that is larger is split by
its rows' ids), queries into chunks; a task compares one chunk with one block and
passes on ten rows for each query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_sample, holding, release, small_batches, staged
from .vectors import lists, matrix, usable, usual_size

#: Centroids of a half, vectors that the codebooks are fitted on, k-means rounds.
CENTROIDS, SAMPLE, ROUNDS = 64, 20_000, 10
#: Recall that the share of visited rows is set for, and the sampled vectors that it is measured with.
TARGET, ASKED = 0.96, 200
#: Rows of a block, and queries of a chunk, at most about.
BLOCK_ROWS, CHUNK = 8192, 4096
TOP, EVERY = 10, 100


def _means(x: np.ndarray, k: int) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


class Codebooks:
    """Centroids of the two halves."""

    def __init__(self, sample: np.ndarray, k: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.first = _means(sample[:, : self.cut], k)
        rest = sample[:, self.cut :] if sample.shape[1] > 1 else np.zeros((len(sample), 1))
        self.second = _means(rest, k)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :] if x.shape[1] > 1 else np.zeros((len(x), 1))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return _nearest(a, self.first) * len(self.second) + _nearest(b, self.second)

    def visit(self, q: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
        """Non-empty cells in order of summed distances until they hold ``want`` rows."""
        a, b = self.halves(q[None])
        da = ((self.first - a) ** 2).sum(1)
        db = ((self.second - b) ** 2).sum(1)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db = da[oa].tolist(), db[ob].tolist()
        oa, ob = oa.tolist(), ob.tolist()
        heap, reached = [(da[0] + db[0], 0, 0)], [0] * len(oa)
        out, got = [], 0
        while heap and got < want:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * len(ob) + ob[j]
            if sizes[cell]:
                out.append(cell)
                got += sizes[cell]
            # (i, j) is pushed once both (i-1, j) and (i, j-1) are out
            reached[i] = j + 1
            if i + 1 < len(oa) and reached[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            if j + 1 < len(ob) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return out


def probe_for(books: Codebooks, sample: np.ndarray, target: float, top: int) -> float:
    """The share of rows that a query must visit to find ``target`` of its ``top`` nearest, as measured on the sample.

    The neighbours of ``ASKED`` sampled vectors are found by brute force; each is
    reached once the cells up to its own are visited.  All rows lie closer
    together than the sample's do, so the share is rather too large.  Vectors
    with structure need a small share, vectors without any nearly half.
    """
    if len(sample) < 2:
        return 1.0
    cells = books.cells(sample)
    sizes = np.bincount(cells, minlength=len(books.first) * len(books.second))
    square = (sample * sample).sum(1)
    reached = []
    for i in np.unique(np.linspace(0, len(sample) - 1, ASKED).astype(int)):
        q = sample[i]
        d = square - 2 * sample @ q
        d[i] = np.inf
        k = min(top, len(sample) - 1)
        near = np.argpartition(d, k - 1)[:k]
        a, b = books.halves(q[None])
        order = np.argsort((((books.first - a) ** 2).sum(1)[:, None] + ((books.second - b) ** 2).sum(1)[None]).ravel(), kind="stable")
        share = np.empty(len(order))
        share[order] = np.cumsum(sizes[order]) / len(sample)
        reached.append(share[cells[near]])
    return float(np.quantile(np.concatenate(reached), target))


def pack(sizes: np.ndarray, most: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For every cell its first block, and the number of blocks that it is split over."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    block, filled = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if n > most or filled + n > most:
            block, filled = block + (filled > 0), 0
        first[c] = block
        if n > most:
            block += int(parts[c])
        else:
            filled += n
    return first, parts


def _ranked(q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray, top: int, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the ``top`` allowed rows of ``x`` nearest to one query; an id
    that ``repeats`` counts once, with its nearest row."""
    at = np.flatnonzero(allowed)
    approx = (x[at] * x[at]).sum(1) - 2 * x[at] @ q
    if len(at) > top and not repeats:
        edge = np.partition(approx, top - 1)[top - 1]
        at = at[approx <= edge + 1e-9 * (1 + abs(edge) + float(q @ q))]
    d = np.sqrt(((x[at] - q) ** 2).sum(1))
    order = np.lexsort((ids[at], d))
    if repeats:
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
    order = order[:top]
    return at[order], d[order]


def search(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    every: int = EVERY,
    top: int = TOP,
    centroids: int = CENTROIDS,
    probe: float | None = None,
    target: float = TARGET,
    block_rows: int = BLOCK_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """The ``top`` nearest found of each row whose id is divisible by ``every``.

    Returns (query_id, rank from 1, vec_id, score), score being the Euclidean
    distance of the original vectors in double precision; ties go to the smaller
    id.  A row is no candidate of a query with its own id.  Vectors that are null,
    empty, zero, of another length than most, or hold null or non-finite
    components take no part, nor do rows without an id.  Rows that repeat count
    once; a table without queries or candidates gives no rows; other columns are
    not read.  A query visits the cells of the share ``probe`` of all rows; if it
    is not given, of as many as ``target``, a recall, needs on the sample.
    """
    spark = rows.sparkSession
    small_batches(spark)
    good = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where(F.col("id").isNotNull() & usable(F.col("v")))
    dim = usual_size(good, "v")
    schema = T.StructType([T.StructField(n, t) for n, t in (("query_id", T.LongType()), ("rank", T.IntegerType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))])
    if dim == 0:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("v") == dim)
    sample = hashed_sample(good, F.col("id"), SAMPLE).toArrow().sort_by("id")
    known = matrix(sample["v"], dim)
    books = Codebooks(known, centroids)
    probe = probe_for(books, known, target, top) if probe is None else probe
    held = spark.sparkContext.broadcast(books)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.cells(x), pa.int64())], names=["id", "v", "cell"])

    entries = staged(good.mapInArrow(assign, "id long, v array<double>, cell long"), "entries")
    # one row for each cell that isn't empty: at most centroids ** 2; ids that repeat count once in a cell
    sizes = np.zeros((2, len(books.first) * len(books.second)), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect():
        sizes[:, r["cell"]] = r["n"], r["ids"]
    distinct = entries.agg(F.countDistinct("id")).first()[0]
    plan = spark.sparkContext.broadcast((sizes[1], *pack(sizes[0], block_rows)))
    queries = entries.where(F.pmod("id", F.lit(every)) == 0).select("id", "v")

    def nearest(asking: DataFrame, want: float) -> DataFrame:
        chunks = max(1, -(-asking.count() // chunk))
        return _compared(entries, asking, dim, held, plan, want, chunks, top)

    near = staged(nearest(queries, max(probe * sizes[1].sum(), top + 1)), "near")
    # An id whose rows lie in several cells counts in each of them: queries that came out short visit all cells.
    found = near.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(found.where(F.col("n") >= min(top, distinct - 1)), F.col("id") == F.col("query_id"), "left_anti")
    parts = [near]
    if not short.isEmpty():
        short = staged(short, "short")
        parts.append(staged(nearest(short, float("inf")), "near"))
        release(short)
    release(entries)
    every_part = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # the same row may be near to two rows of one query id: the smaller distance counts
    once = every_part.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return holding(once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), *parts)


def _compared(entries: DataFrame, queries: DataFrame, dim: int, held, plan, want: float, chunks: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the ``top`` nearest of each row of ``queries`` in every block of the cells
    that it visits until they hold ``want`` ids; ``held`` are the codebooks, ``plan`` the cells' ids and blocks."""

    def route(batches):
        sizes, first, parts = plan.value
        for b in batches:
            ids, chunk_no = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = matrix(b.column(2), dim)
            block, at, cells = [], [], []
            for i, q in enumerate(x):
                by_block: dict[int, list[int]] = {}
                for c in held.value.visit(q, sizes, want):
                    for part in range(parts[c]):
                        by_block.setdefault(int(first[c]) + part, []).append(c)
                block += by_block
                at += [i] * len(by_block)
                cells += by_block.values()
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(chunk_no[at]), pa.array(ids[at]), b.column(2).take(pa.array(at)), pa.array(cells, pa.list_(pa.int64()))],
                names=["block", "chunk", "id", "v", "cells"],
            )

    def place(batches):
        _, first, parts = plan.value
        for b in batches:
            cell, h = b.column(2).to_numpy(), b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + h % parts[cell]), b.column(0), b.column(1), b.column(2)], names=["block", "id", "v", "cell"])

    chunk_of = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("long")
    asked = queries.select("id", chunk_of.alias("chunk"), "v").mapInArrow(route, "block long, chunk long, id long, v array<double>, cells array<long>")
    spread = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    placed = entries.select("id", "v", "cell", spread.alias("h")).mapInArrow(place, "block long, id long, v array<double>, cell long")
    placed = placed.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "v", "cell")

    def compare(asks: pa.Table, block: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(asks) and len(block):
            q, x = matrix(asks["v"], dim), matrix(block["v"], dim)
            qid, ids, cell = asks["id"].to_numpy(), block["id"].to_numpy(), block["cell"].to_numpy()
            known, where = np.unique(cell, return_inverse=True)
            repeats = len(np.unique(ids)) < len(ids)
            for i, cells in enumerate(asks["cells"].to_pylist()):
                open_cells = np.isin(known, cells)
                at, d = _ranked(q[i], x, ids, open_cells[where] & (ids != qid[i]), top, repeats)
                for o, value in zip(out, (np.full(len(at), qid[i]), ids[at], d)):
                    o.append(value)
        join = lambda o, kind: pa.array(np.concatenate(o) if o else [], kind)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    return asked.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk")).applyInArrow(compare, "query_id long, vec_id long, score double")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Contract query: query_id, rank, vec_id, score."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
