"""Token counts that follow edits.

A text is cut into pre-tokens; its tree holds, for every pre-token, the number
of characters and of tokens, and their sums above.  An edit descends the tree to
the place that it touches, cuts the text anew from the last boundary that it
cannot affect, stops where the new boundaries meet the old ones, encodes only
these pre-tokens, and updates the sums on the way up.

The pre-token expression looks ahead but never back: how a text is cut from a
boundary on depends on what follows alone, and whether a pre-token ends where it
does on at most two characters after it.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Where the registered query finds its ranks (a parameter of every function).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the expression that cuts texts before these ranks' merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a pre-token that can bear on where it ends.
LOOKAHEAD = 2
#: Distinct pre-tokens whose counts a worker remembers.
MEMO = 400_000


class Counts:
    """Counts of tokens by pre-token, for one vocabulary."""

    def __init__(self, blob: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.expression = regex.compile(spaces)
        self.memo: dict[str, int] = {}

    def cut(self, text: str, at: int = 0):
        """Pre-tokens from ``at`` on, one by one."""
        return (m.group() for m in self.expression.finditer(text, at))

    def counts(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        encode = self.encoding.encode_ordinary
        for p in set(pieces).difference(memo):
            memo[p] = len(encode(p))
        return list(map(memo.__getitem__, pieces))


class Tree:
    """The pre-tokens of one text with sums of characters and tokens.

    ``parts[i]`` are the pre-tokens of leaf i: one at first, several or none
    after edits.
    """

    def __init__(self, counter: Counts, text: str, stored: tuple[np.ndarray, np.ndarray] | None = None):
        self.counter = counter
        if stored is None:
            pieces = counter.expression.findall(text)
            chars, tokens = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(counter.counts(pieces), np.int64)
        else:  # lengths say where the pre-tokens are; nothing is cut or encoded again
            chars, tokens = stored
            ends = np.cumsum(chars).tolist()
            pieces = [text[e - n : e] for e, n in zip(ends, chars.tolist())]
        self.parts = [[p] for p in pieces]
        size = 1
        while size < max(1, len(pieces)):
            size *= 2
        self.size = size
        sums = np.zeros((2, 2 * size), np.int64)
        sums[0, size : size + len(pieces)] = chars
        sums[1, size : size + len(pieces)] = tokens
        while size > 1:
            half = size // 2
            sums[:, half:size] = sums[:, size : 2 * size : 2] + sums[:, size + 1 : 2 * size : 2]
            size = half
        # node 1 is the root, nodes 2i and 2i+1 are below node i
        self.char_sums, self.token_sums = sums[0].tolist(), sums[1].tolist()
        self.encoded = 0  # characters that edits had encoded again

    @property
    def chars(self) -> int:
        return self.char_sums[1]

    @property
    def tokens(self) -> int:
        return self.token_sums[1]

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        at = leaf + self.size
        c, t = chars - self.char_sums[at], tokens - self.token_sums[at]
        while at and (c or t):
            self.char_sums[at] += c
            self.token_sums[at] += t
            at //= 2

    def locate(self, place: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds character ``place`` (the last one's end: the last leaf)."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            left = self.char_sums[at]
            if place >= start + left and self.char_sums[at + 1]:
                start += left
                at += 1
        return at - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` by ``new``."""
        if not self.parts:
            self.parts = [[]]
        start, end = max(0, min(start, self.chars)), max(0, min(end, self.chars))
        end = max(start, end)
        if start == end and not new:
            return
        first, at = self.locate(max(0, start - LOOKAHEAD))
        # old pre-tokens from ``at`` on, as far as needed, and where each leaf begins
        last, have, old, begins = first - 1, at, [], {}
        more_leaves = 3
        while True:
            wanted = more_leaves
            while last + 1 < len(self.parts) and (have < end or wanted > 0):
                last += 1
                begins[have - at] = last
                old += self.parts[last]
                wanted -= bool(self.parts[last]) and have >= end
                have = at + (have - at) + self.char_sums[last + self.size]
            full = last + 1 >= len(self.parts)
            text = "".join(old)
            changed = text[: start - at] + new + text[end - at :]
            bounds, b = {}, 0
            for i, p in enumerate(old):
                bounds[b] = i
                b += len(p)
            bounds[b] = len(old)
            after, shift = start - at + len(new), len(new) - (end - start)
            made, place, met = [], 0, None
            for p in self.counter.cut(changed):
                if place >= after and place - shift in bounds:
                    met = place - shift
                    break
                # what lies at the end of the window may go on beyond it
                if not full and place + len(p) + LOOKAHEAD > len(changed):
                    break
                made.append(p)
                place += len(p)
            else:
                met = b if full else None
            if met is not None:
                break
            more_leaves *= 4
        self.encoded += sum(map(len, made))
        # Leaves from where old and new meet stay; a leaf that is cut there keeps its rest,
        # unless it is the first one.  So no leaf grows with the number of edits behind it.
        begin = max(x for x in begins if x <= met)
        meet = begins[begin]
        rest = []
        if begin < met or meet == first:
            inside = min((x for x in begins if x > begin), default=b)
            rest = old[bounds[met] : bounds[inside]]
        if meet == first:
            made, meet = made + rest, first + 1
        elif rest or begin < met:
            self._put(meet, rest)
        self._put(first, made)
        for leaf in range(first + 1, meet):
            if self.parts[leaf]:
                self._put(leaf, [])

    def _put(self, leaf: int, parts: list[str]) -> None:
        self.parts[leaf] = parts
        self._set(leaf, sum(map(len, parts)), sum(self.counter.counts(parts)))

    def text(self) -> str:
        return "".join("".join(p) for p in self.parts)


_counters: dict[bytes, Counts] = {}


def counter_of(blob: bytes) -> Counts:
    if blob not in _counters:
        _counters.clear()
        _counters[blob] = Counts(blob)
    return _counters[blob]


#: The registered query's edits: runs of white space become one space or line
#: end, runs of one sign one sign, and long numbers a mark.
_CLEANING = re.compile(r"\s{2,}|([^\w\s])\1+|[0-9]{6,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) in order, not overlapping; clean texts have none."""
    out = []
    for m in _CLEANING.finditer(text):
        found = m.group()
        if found.isspace():
            new = "\n" if "\n" in found else " "
        else:
            new = m.group(1) or "<number>"
        out.append((m.start(), m.end(), new))
    return out


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def trees(docs: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the leaves of its tree: ``leaf_chars`` and ``leaf_tokens``.

    Null texts count as empty.  Stored with the documents, the leaves save later
    edits from cutting or encoding a text again.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    keep = docs.columns
    names = []
    for n in ("n_tokens", "leaf_chars", "leaf_tokens"):
        names.append(fresh([*keep, *names], n))
    schema = docs.schema
    schema = T.StructType([*schema.fields, T.StructField(names[0], T.LongType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[1:])])
    where = keep.index(text)

    def run(batches):
        c = counter_of(blob.value)
        for b in batches:
            chars, tokens = [], []
            for t in b.column(where).to_pylist():
                pieces = c.expression.findall(t or "")
                chars.append(list(map(len, pieces)))
                tokens.append(c.counts(pieces))
            leaf = [pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(list(map(sum, tokens)), pa.int64()), *leaf], names=[*keep, *names])

    return docs.mapInArrow(run, schema)


def apply_edits(stored: DataFrame, edits: DataFrame, ranks: str = RANKS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts after edits of documents that :func:`trees` has counted.

    ``edits`` has (id, start, end, replacement) in code points of the stored
    text; of edits that overlap, the one that starts (then ends) first is made.
    Returns (id, n_tokens, n_tokens_after, n_edits, n_chars_encoded) for every
    row of ``stored``.
    """
    blob = stored.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("replacement", F.lit("")).alias("new"))
    by_doc = edits.where("start IS NOT NULL AND end IS NOT NULL").groupBy(F.col(id).alias("__id")).agg(F.array_sort(F.collect_list(one)).alias("__edits"))
    both = stored.select(F.col(id).alias("id"), F.col(text).alias("t"), "n_tokens", "leaf_chars", "leaf_tokens").join(by_doc, F.col("id") == F.col("__id"), "left")
    schema = T.StructType([T.StructField(id, stored.schema[id].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_after", "n_edits", "n_chars_encoded"))])
    names = schema.names

    def run(batches):
        c = counter_of(blob.value)
        for b in batches:
            out = []
            for t, n, chars, tokens, todo in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                edits_of_row, at = [], 0
                for e in todo or []:
                    if e["start"] >= at and e["end"] >= e["start"]:
                        edits_of_row.append((e["start"], e["end"], e["new"]))
                        at = max(at, e["end"])
                out.append((n, *_after(c, t or "", n, edits_of_row, (np.array(chars, np.int64), np.array(tokens, np.int64)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4))], names=names)

    return both.select("id", "t", "n_tokens", "leaf_chars", "leaf_tokens", "__edits").mapInArrow(run, schema)


def _after(c: Counts, text: str, n: int, edits: list, stored=None) -> tuple[int, int, int]:
    """(tokens, edits, characters encoded again) after edits in order of place."""
    if not edits:
        return n, 0, 0
    tree = Tree(c, text, stored)
    for start, end, new in reversed(edits):
        tree.edit(start, end, new)
    return tree.tokens, len(edits), tree.encoded


def count_and_edit(docs: DataFrame, find_edits=cleaning_edits, ranks: str = RANKS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_tokens_after, n_edits, n_chars_encoded) of every row, in one pass.

    ``find_edits`` gives a text's edits in order, not overlapping.  Null and
    empty texts have no tokens; rows that repeat stay; other columns are not read.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_after", "n_edits", "n_chars_encoded"))])
    names = schema.names

    def run(batches):
        c = counter_of(blob.value)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                pieces = c.expression.findall(t or "")
                counts = c.counts(pieces)
                n, edits = sum(counts), find_edits(t or "")
                stored = (np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(counts, np.int64)) if edits else None
                out.append((n, *_after(c, t or "", n, edits, stored)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4))], names=names)

    return docs.select(id, F.col(text).cast("string")).mapInArrow(run, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_chars_encoded of every document."""
    return count_and_edit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
