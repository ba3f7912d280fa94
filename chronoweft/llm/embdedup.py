"""Embedding near-dedup by a forest of random-projection trees.

Vectors are split again and again by a random direction, at a sparse place near
the middle of a node's projections, with the rows around the cut going to both
sides (spill); several trees see different directions.  Only vectors of one label
in a common leaf are compared, every cosine is computed exactly in double
precision, and what the leaves find is united.

The upper levels of all trees are fitted on a bounded sample and sent to the
tasks, so one pass without a shuffle finds every vector's nodes; nodes that are
still too large are split on in rounds, each by cuts fitted on a sample of its
own rows.  Until then only numbers of rows and nodes travel; the vectors join them
once, and are dealt out by leaf once.

Exact copies are one vector with a count.  A pair that meets in several leaves
counts in the first of them, which both rows can tell from their lists of
leaves, so leaves pass on counts for each vector and a spanning forest, never
pairs.  A leaf that cannot be split, such as a clump of thousands of near
copies, is compared in blocks, by a task for each pair of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hashed_sample, holding, min_labels, release, small_batches, staged
from .vectors import matrix, usable

THRESHOLD = 0.98
#: Trees, rows of a leaf (about), share of a node's rows on either side of a cut that spill.
TREES, LEAF, SPILL = 6, 512, 0.03
#: Vectors that the upper levels are fitted on, and those a node of theirs must have.
UPPER_SAMPLE, UPPER_LEAST = 20_000, 64
#: Rows of a lower node that its cuts are fitted on (about), levels that a round splits,
#: and rounds after which a node is a leaf whatever its size: its rows are then compared in blocks.
SAMPLE, LEVELS, ROUNDS = 2000, 4, 24
#: A node is a clump, and not split, if so many of its sampled pairs are links.
CLUMP = 0.5
#: Rows of a block, and salts of the join that gives components their smallest id.
BLOCK, SALTS = 2048, 16


def _direction(tree: int, node: int, place: int, dim: int) -> np.ndarray:
    return np.random.default_rng([tree, node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF, place]).standard_normal(dim)


def _cut(p: np.ndarray) -> tuple[float, float]:
    """(low, high): rows from low on go right, up to high go left.  The cut lies
    where the sorted projections are sparsest, not far from the middle."""
    s = np.sort(p)
    n = len(s)
    w = max(1, int(n * SPILL))
    a, b = int(n * 0.3), max(int(n * 0.3) + 1, int(n * 0.7))
    mid = np.arange(max(a, w), max(max(a, w) + 1, min(b, n - w)))
    mid = np.clip(mid, 0, n - 1)
    best = mid[np.argmax(s[np.minimum(mid + w, n - 1)] - s[np.maximum(mid - w, 0)])]
    return float(s[max(best - w, 0)]), float(s[min(best + w, n - 1)])


def _is_clump(x: np.ndarray) -> bool:
    """Whether at least ``CLUMP`` of the pairs of some rows are links."""
    some = x[:: -(-len(x) // 128) or 1]
    linked = some @ some.T >= THRESHOLD
    return len(some) > 1 and (linked.sum() - len(some)) / (len(some) * (len(some) - 1)) >= CLUMP


def _fit_cuts(tree: int, node: int, x: np.ndarray, levels: int) -> list[float]:
    """Cuts of a subtree in heap order, (low, high) each; a clump goes left as a whole."""
    cuts, rows = [], {1: np.arange(len(x))}
    for place in range(1, 1 << levels):
        at = rows[place]
        p = x[at] @ _direction(tree, node, place, x.shape[1])
        low, high = (math.inf, math.inf) if _is_clump(x[at]) else _cut(p) if len(at) > 1 else (0.0, 0.0)
        cuts += [low, high]
        rows[2 * place], rows[2 * place + 1] = at[p <= high], at[p >= low]
    return cuts


def _descend(tree: int, node: int, x: np.ndarray, cuts: list[float]) -> list[tuple[int, np.ndarray]]:
    """(leaf place, rows) of a subtree."""
    out, todo = [], [(1, np.arange(len(x)))]
    inner = len(cuts) // 2 + 1
    while todo:
        place, at = todo.pop()
        if not len(at):
            continue
        if place >= inner:
            out.append((place, at))
            continue
        low, high = cuts[2 * place - 2], cuts[2 * place - 1]
        p = x[at] @ _direction(tree, node, place, x.shape[1])
        todo += [(2 * place, at[p <= high]), (2 * place + 1, at[p >= low])]
    return out


def _links(u: np.ndarray, v: np.ndarray, threshold: float, same: bool, step: int = 1024):
    """Positions (i, j) of the pairs with a cosine of at least ``threshold``; i < j if ``same``.

    Cosines come from a product of matrices; where rounding could matter they are
    summed again, pair by pair.
    """
    nu, nv = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
    for a in range(0, len(u), step):
        b0 = a if same else 0
        c = (u[a : a + step] @ v[b0:].T) / nu[a : a + step, None] / nv[None, b0:]
        i, j = np.nonzero(c >= threshold - 1e-9)
        close = np.flatnonzero(c[i, j] < threshold + 1e-9)
        i, j = i + a, j + b0
        p, q = i[close], j[close]
        ok = np.ones(len(i), bool)
        ok[close] = (u[p] * v[q]).sum(1) / (nu[p] * nv[q]) >= threshold
        if same:
            ok &= i < j
        yield i[ok], j[ok]


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that rows of two sorted, zero-padded matrices share."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        hit = (a[:, k : k + 1] == b).any(1) & (a[:, k] != 0)
        out = np.where(hit & (a[:, k] < out), a[:, k], out)
    return out


class Upper:
    """The upper levels of all trees: directions and cuts by tree and place in heap order."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int):
        x = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
        self.levels, places = levels, range(1, 1 << levels)
        self.directions = [np.array([_direction(t, 0, p, x.shape[1]) for p in places]).reshape(-1, x.shape[1]) for t in range(trees)]
        self.cuts = [np.array(_fit_cuts(t, 0, x, levels)).reshape(-1, 2) for t in range(trees)]

    def leaves(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the leaf) of unit vectors; spilled rows come more than once."""
        at, place = np.arange(len(x)), np.ones(len(x), np.int64)
        p = x @ self.directions[tree].T
        for _ in range(self.levels):
            v, (low, high) = p[at, place - 1], self.cuts[tree][place - 1].T
            left, right = v <= high, v >= low
            at, place = np.concatenate((at[left], at[right])), np.concatenate((2 * place[left], 2 * place[right] + 1))
        return at, place


def _upper_nodes(reps: DataFrame, dim: int, trees: int, leaf: int, upper_sample: int) -> DataFrame:
    """(rid, tree, node) of the nodes that the upper levels put each vector in; one tree if there is nothing to split."""
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = hashed_sample(reps.select("v"), F.col("v"), upper_sample).toArrow() if most > leaf else None
    room = 0 if sample is None else int(math.log2(max(1, len(sample) // UPPER_LEAST)))
    # one level more than halves would need: cuts are not in the very middle, and lower levels cost more
    levels = min(room, 1 + math.ceil(math.log2(most / leaf))) if most > leaf else 0
    if not levels:
        one = reps.select("rid", "label", F.explode(F.sequence(F.lit(0), F.lit(0 if most <= leaf else trees - 1))).alias("tree"))
        return one.select("rid", "tree", F.xxhash64("label", "tree").alias("node"))
    x = matrix(sample["v"], dim)
    held = reps.sparkSession.sparkContext.broadcast(Upper(x[np.lexsort(x.T[:3])], trees, levels))

    def run(batches):
        upper = held.value
        for b in batches:
            x = matrix(b.column(2), dim)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            for tree in range(len(upper.cuts)):
                at, place = upper.leaves(tree, x)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(len(at), tree), pa.int32()), pa.array(place)], names=["rid", "label", "tree", "place"]
                )

    from pyspark.sql import types as T

    schema = reps.select("rid", "label").schema.add("tree", T.IntegerType()).add("place", T.LongType())
    return reps.select("rid", "label", "v").mapInArrow(run, schema).select("rid", "tree", F.xxhash64("label", "tree", "place").alias("node"))


def forest(reps: DataFrame, dim: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, upper_sample: int = UPPER_SAMPLE) -> DataFrame:
    """(rid, tree, node) of every leaf that a vector is in; ``reps`` has (rid, label, v)."""
    small_batches(reps.sparkSession)
    vectors = reps.select(F.col("rid").alias("r"), "v")
    done, open_rows = [], staged(_upper_nodes(reps, dim, trees, leaf, upper_sample), "nodes")
    for no in range(ROUNDS):
        sizes = open_rows.groupBy("tree", "node").agg(F.count("*").alias("size"))
        large = staged(sizes.where(F.col("size") > leaf).select(F.col("tree").alias("t"), F.col("node").alias("n"), "size"), "sizes")
        if large.isEmpty():
            release(large)
            break
        on = (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))
        done.append(staged(open_rows.join(large, on, "left_anti"), "nodes"))
        split = open_rows.join(large, on).select("rid", "tree", "node", "size")
        chance = F.lit(float(sample)) / F.col("size")
        luck = F.pmod(F.xxhash64("rid", "tree", F.lit(no)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        fit_on = split.where(luck < chance).join(vectors, F.col("rid") == F.col("r")).select("tree", "node", "size", "v")

        def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            tree, node = (k.as_py() for k in key)
            size = table["size"][0].as_py()
            levels = max(1, min(LEVELS, math.ceil(math.log2(size / leaf))))
            x = matrix(table["v"], dim)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            # the order of rows must not matter
            x = x[np.lexsort(x.T[:3])]
            cuts = [] if _is_clump(x) else _fit_cuts(tree, node, x, levels)
            return pa.table({"t": pa.array([tree], pa.int32()), "n": pa.array([node], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

        cuts = staged(fit_on.groupBy("tree", "node").applyInArrow(fit, "t int, n long, cuts array<double>"), "cuts")
        # a node without a cut, for want of sampled rows or as a clump, is a leaf
        cut = cuts.where(F.size("cuts") > 0)
        done.append(staged(split.join(cut, on, "left_anti").select("rid", "tree", "node"), "nodes"))

        def route(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                tree, node = b.column(1).to_numpy(), b.column(2).to_numpy()
                x = matrix(b.column(3), dim)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                cuts = b.column(4)
                order = np.lexsort((node, tree))
                turn = np.flatnonzero((np.diff(node[order]) != 0) | (np.diff(tree[order]) != 0)) + 1
                take, child = [], []
                for at in np.split(order, turn):
                    for place, sub in _descend(int(tree[at[0]]), int(node[at[0]]), x[at], cuts[int(at[0])].as_py()):
                        take.append(at[sub])
                        child.append(np.full(len(sub), place))
                take, child = np.concatenate(take), np.concatenate(child)
                kept = pa.array(take)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(kept) for i in range(3)), pa.array(child, pa.int64())], names=["rid", "tree", "node", "place"])

        with_vector = split.join(vectors, F.col("rid") == F.col("r")).join(cut, on).select("rid", "tree", "node", "v", "cuts")
        moved = with_vector.mapInArrow(route, "rid long, tree int, node long, place long")
        nxt = staged(moved.select("rid", "tree", F.xxhash64("node", "place").alias("node")), "nodes")
        release(open_rows, large, cuts)
        open_rows = nxt
    out = open_rows
    for d in done:
        out = out.unionByName(d)
    return holding(out, open_rows, *done)


def compared(reps: DataFrame, nodes: DataFrame, dim: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(rid, links, root) for the rows of every leaf of ``nodes``: links counted there, and the
    smallest row that the leaf connects each to.  ``reps`` has (rid, m, v)."""
    leaves = nodes.select("rid", F.xxhash64("tree", "node").alias("leaf"))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks"))
    lists = leaves.join(sizes, "leaf").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("leaf", "blocks"))).alias("at"))
    rows = reps.select("rid", "m", "v").join(lists, "rid")
    rows = rows.select("rid", "m", "v", F.transform("at", lambda x: x["leaf"]).alias("all"), F.explode("at").alias("l"))
    rows = rows.select("rid", "m", "v", "all", "l.leaf", "l.blocks", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("l.blocks")).cast("int").alias("part"))
    # the pairs of blocks that a row's block is in: (part, j) and (i, part)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"))
    )
    rows = rows.withColumn("pair", F.explode(pairs)).select("leaf", "pair.i", "pair.j", "part", "rid", "m", "v", "all")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key)
        rid, m = table["rid"].to_numpy(), table["m"].to_numpy()
        part, x = table["part"].to_numpy(), matrix(table["v"], dim)
        order = np.argsort(rid, kind="stable")
        a, b = order[part[order] == i], order[part[order] == j]
        count, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        # roots by ascending rid
        rank = np.empty(len(rid), np.int64)
        rank[order] = np.arange(len(rid))
        member = None
        for s, t in _links(x[a], x[b], threshold, i == j):
            if not len(s):
                continue
            if member is None:
                member = _members(table["all"].combine_chunks())
            s, t = a[s], b[t]
            for c in range(0, len(s), 1 << 17):
                p, q = s[c : c + (1 << 17)], t[c : c + (1 << 17)]
                here = _first_common(member[p], member[q]) == leaf
                count += np.bincount(p[here], m[q[here]], len(rid)).astype(np.int64)
                count += np.bincount(q[here], m[p[here]], len(rid)).astype(np.int64)
                root = min_labels(len(rid), rank[p], rank[q], root)
        top = rid[order][root[rank]]
        hit = np.flatnonzero((count > 0) | (top != rid))
        return pa.table({"rid": pa.array(rid[hit], pa.int64()), "links": pa.array(count[hit], pa.int64()), "root": pa.array(top[hit], pa.int64())})

    return rows.groupBy("leaf", "i", "j").applyInArrow(run, "rid long, links long, root long")


def _members(lists: pa.Array) -> np.ndarray:
    """Lists of leaves as a zero-padded matrix."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(1, int(np.max(lengths, initial=1)))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, **how) -> DataFrame:
    """One row for each row of ``rows``: (id, n_links, component_id, kept).

    Vectors of an equal, non-null label and of equal length link at a cosine of
    ``threshold`` or more.  Null, empty and zero vectors, vectors with null or
    non-finite components, and rows without an id or a label link with nothing:
    0 links, themselves their component, kept (null for a null id).  Rows that
    repeat an id and a vector are copies that link.  Other columns are not read.
    """
    kind = rows.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    base = rows.select(F.col(id).cast("long").alias("id"), v.alias("v"), F.col(label).alias("label"))
    part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    good, rest = base.where(part), base.where(~part)
    distinct = good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("m"))
    reps = staged(distinct.select(F.monotonically_increasing_id().alias("rid"), "low", "m", "label", "v"), "vectors")
    found = []
    for dim in sorted(r[0] for r in reps.select(F.size("v")).distinct().collect()):
        some = reps.where(F.size("v") == dim)
        nodes = forest(some, dim, **how)
        found.append(staged(compared(some, nodes, dim, threshold, block), "found"))
        release(nodes)
    alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = None
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        links = every.groupBy("rid").agg(F.sum("links").alias("links"))
        comp = components(every.select(F.col("rid").alias("u"), F.col("root").alias("v")))
        known = (
            reps.select("rid", "low", "m")
            .join(links, "rid", "left")
            .join(comp, F.col("rid") == F.col("node"), "left")
            .select("rid", "low", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root"))
        )
        # A component may hold a third of the rows: its smallest id goes to them by salted keys.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        lows = known.groupBy("root").agg(F.min("low").alias("component_id")).select("root", "component_id", salts)
        known = known.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(lows, ["root", "salt"]).select("rid", "n_links", "component_id")
        known = staged(known, "known")
        release(*found, comp)
        of_row = good.join(reps.select("rid", "label", "v"), ["label", "v"]).select("id", "rid")
        linked = of_row.join(known, "rid").select("id", "n_links", "component_id")
        alone = linked.unionByName(alone)
        found = [known]
    out = alone.select(F.col("id").alias(id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return holding(out, reps, *found)


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: vec_id, n_links, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
