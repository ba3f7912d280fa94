"""SimHash near-duplicate detection by a binary-trie self-join.

Fingerprints are made once per document; from then on only *distinct*
fingerprints travel, so a group of thousands of exact copies is one row.  Two
fingerprints with at most ``k`` differing bits agree in at least one of ``k+1``
bit blocks (or two of ``k+2``, three of ``k+3`` at larger sizes), which gives
the keys by which they are dealt out.  Within the keys of a task a binary trie over
the sorted fingerprints is joined with itself: node pairs descend together, each
unequal branch costs one of the ``k`` errors, and a pair is cut off as soon as
the budget is spent, or when both sides are known to be one component already.
Each task reports a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, fresh_all, holding, min_labels, release, small_batches, staged

SEED = 42
SHINGLE = 4
MAX_BITS = 4
_CHUNK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text (UTF-8), as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        j = min(n, i + _CHUNK)
        h = np.fromiter(
            (digest(flat[a:b], SEED) for a, b in zip(starts[i:j].tolist(), stops[i:j].tolist())), "<u8", j - i
        )
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """``docs`` without its text, and ``out``: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add(out, "long")

    def run(batches):
        for b in batches:
            texts = b.column(len(keep)).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp, pa.int64())], names=[*keep, out])

    return docs.select(*keep, F.col(text).cast("string").alias(fresh(keep, "text"))).mapInArrow(run, schema)


def blocks_for(n: int, k: int) -> list[list[int]]:
    """Masks whose equality any two fingerprints within ``k`` bits share at least once."""
    extra = 1 if n <= 1 << 22 else 2 if n <= 1 << 30 else 3
    parts = k + extra
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    return [sum(masks[i] for i in c) for c in combinations(range(parts), extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trie_links(fps: np.ndarray, segments: np.ndarray, k: int, leaf: int = 16, step: int = 1 << 21) -> np.ndarray:
    """Join tries with themselves.

    ``fps`` (uint64) holds runs of ascending distinct values; ``segments`` are
    the runs' bounds, each run a trie of its own.  Returns for every position
    the smallest position reachable over links of at most ``k`` differing bits.
    """
    n = len(fps)
    root = np.arange(n)
    lo, hi = segments[:-1], segments[1:]
    big = bool(len(lo)) and int((hi - lo).max()) > 4096
    for budget in [1, k] if big and k > 1 else [k]:
        a0, a1 = lo[hi - lo > 1], hi[hi - lo > 1]
        b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), np.int64)
        for bit in range(63, -2, -1):
            if len(a0) == 0:
                break
            same = a0 == b0
            # both sides are one component already: nothing to find
            turns = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
            done = (root[a0] == root[b0]) & (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1])
            few = ((a1 - a0) <= leaf) & ((b1 - b0) <= leaf) | (bit < 0)
            at = np.flatnonzero(few & ~done)
            sizes = (a1 - a0)[at] * (b1 - b0)[at]
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // step, prepend=-1))
            for p in np.split(at, cut[1:]) if len(at) else []:
                m, w = (a1 - a0)[p] * (b1 - b0)[p], (b1 - b0)[p]
                own = np.repeat(np.arange(len(p)), m)
                j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                x, y = a0[p][own] + j // w[own], b0[p][own] + j % w[own]
                ok = (np.bitwise_count(fps[x] ^ fps[y]) <= budget) & (root[x] != root[y])
                if ok.any():
                    root = min_labels(n, x[ok], y[ok], root)
            go = ~few & ~done
            a0, a1, b0, b1, err, same = a0[go], a1[go], b0[go], b1[go], err[go], same[go]
            if len(a0) == 0 or bit < 0:
                break
            zeros = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)))
            am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
            other = ~same
            parts = [
                (a0, am, b0, bm, err),
                (am, a1, bm, b1, err),
                (a0, am, bm, b1, err + 1),
                (am[other], a1[other], b0[other], bm[other], err[other] + 1),
            ]
            a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*parts))
            ok = (a1 > a0) & (b1 > b0) & (err <= budget) & ((a0 != b0) | (a1 - a0 > 1))
            a0, a1, b0, b1, err = a0[ok], a1[ok], b0[ok], b1[ok], err[ok]
    return root


def near_links(distinct: DataFrame, k: int = MAX_BITS) -> DataFrame:
    """Links ``(u, v)`` that join the fingerprints ``fp`` within ``k`` bits into their components."""
    n = distinct.count()
    masks = blocks_for(n, k)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(i).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("b"),
    ).select(F.xxhash64("b.j", "b.key").alias("key"), "fp")
    parts = max(12, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 2_000_000)

    def run(batches):
        keys, fps = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            fps.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        key, fp = np.concatenate(keys), np.concatenate(fps)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        if len(key):
            bounds = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            root = trie_links(fp, bounds, k)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (moved, root[moved])], names=["u", "v"])

    return keyed.repartition(parts, "key").mapInArrow(run, "u long, v long")


#: Salts of the join that gives a component's fingerprints its first place, and the
#: part of all rows from which a fingerprint is sent to the rows and not dealt out
#: with them: so there are at most ``HOT`` of these.
SALTS, HOT = 16, 1000


def _grouped(docs: DataFrame, id: str, text: str, k: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of every row, and for every fingerprint (fp, n, low): its rows, and the first row of its component.

    ``low`` is the smallest (no id, id, hash of the text), so rows without an id come last.
    """
    t = F.col(text).cast("string")
    base = docs.select(F.col(id).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))
    made = staged(fingerprints(base, "text", shingle), "simhash")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    distinct = made.groupBy("fp").agg(F.count("*").alias("n"), F.min(place).alias("low"))
    comp = components(near_links(distinct.select("fp"), k))
    linked = distinct.join(comp, F.col("fp") == F.col("node"))
    # Nodes are linked to their root; the root itself has no row in comp.
    ends = linked.select("root", "low").unionByName(distinct.join(comp.select("root").distinct(), F.col("fp") == F.col("root")).select("root", "low"))
    lows = ends.groupBy("root").agg(F.min("low").alias("first"))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    spread = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    moved = comp.select(F.col("node").alias("fp"), "root").unionByName(lows.select(F.col("root").alias("fp"), "root"))
    moved = moved.withColumn("salt", salt).join(spread, ["root", "salt"]).select("fp", "first")
    by_fp = staged(distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("first", "low").alias("low")), "groups")
    release(comp)
    return made, holding(by_fp, made, by_fp)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``fp`` (signed long), ``component_id``.

    ``component_id`` is the smallest id that can be reached over fingerprints
    at ``k`` or fewer differing bits, the row's own included.  Null and empty
    texts have fingerprint zero and link like any other; rows that repeat an id
    stay; a null id is never a component's id unless the component has no other.
    Other columns are not read.  An empty table gives an empty result.
    """
    made, by_fp = _grouped(docs, id, text, k, shingle)
    is_hot = F.col("n") * HOT >= made.count()
    groups = by_fp.select("fp", F.col("low.id").alias("component_id"), F.lit(True).alias("known"), is_hot.alias("hot"))
    # the fingerprint of a large group of copies is one row, and its rows stay where they are
    first = made.join(F.broadcast(groups.where("hot").drop("hot")), "fp", "left")
    rest = first.where("known IS NULL").select("id", "fp").join(groups.where("NOT hot"), "fp")
    out = first.where("known").select("id", "fp", "component_id").unionByName(rest.select("id", "fp", "component_id"))
    return holding(out.select(F.col("id").alias(id), "fp", "component_id"), by_fp)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with exactly one row of each component, chosen as a row and not by its id alone.

    It is the row with the smallest id, a null one last; of rows that repeat
    that id the one whose text has the smallest ``xxhash64``, and of rows that
    repeat id and text the one whose other columns, as JSON, have the smallest.
    Null and empty texts are one component.  Columns of any name are carried
    along.  An empty table gives an empty result.
    """
    made, by_fp = _grouped(docs, id, text, k, shingle)
    heads = by_fp.select("low.id", "low.th").distinct()
    # how many rows a head has: only the few that repeat are gathered by id and text
    rows = made.groupBy("id", "th").agg(F.count("*").alias("n"))
    heads = heads.join(rows, heads["id"].eqNullSafe(rows["id"]) & (heads["th"] == rows["th"])).select(heads["id"].alias("id"), heads["th"].alias("th"), "n")
    h, head, th, n = fresh_all(docs.columns, "h", "head", "th", "n")
    heads = heads.select(F.col("id").alias(head), F.col("th").alias(th), F.col("n").alias(n))
    kept = docs.withColumn(h, F.xxhash64(F.col(text).cast("string"))).join(heads, F.col(id).eqNullSafe(F.col(head)) & (F.col(h) == F.col(th)))
    rest = [c for c in docs.columns if c not in (id, text)]
    order = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    one = kept.where(F.col(n) > 1).groupBy(id, h).agg(F.min_by(F.struct(*docs.columns), order).alias(head)).select(f"{head}.*")
    return holding(kept.where(F.col(n) == 1).select(*docs.columns).unionByName(one), by_fp)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return holding(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), found)
