import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweft.llm import simhash as M
from chronoweft.llm.common import components, min_labels


def plain(text, k=4):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in t + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_is_the_definition():
    for t in ("", None, " \t", "One", "A b c", "a b c d e f g h " * 9, "Ä É x y\vz\x1cq w", "the the the the the"):
        assert M.fingerprint(None if t is None else t.encode()) == plain(t), t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40), st.integers(1, 5), st.randoms())
def test_trie_join_is_brute_force(seed, k, rnd):
    fps = set(seed)
    for x in seed:  # near copies
        for _ in range(3):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, k + 1)):
                y ^= 1 << b
            fps.add(y)
    u = np.array(sorted(fps), np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None]) <= k
    a, b = np.nonzero(d)
    want = min_labels(len(u), a, b)
    assert (M.trie_links(u, np.array([0, len(u)]), k, leaf=3) == want).all()


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    e = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    label = {}
    real = [(a, b) for a, b in e if a is not None and a != b]
    for a, b in real:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in real:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    assert got == {k: v for k, v in label.items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (4, "quite other words here " * 5), (2, None), (8, ""), (8, ""), (None, base), (1, "one two")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in M.near_duplicates(df).collect())
    fp = [plain(t) for _, t in rows]
    a, b = np.nonzero(np.array([[bin(x ^ y).count("1") <= 4 for y in fp] for x in fp]))
    root = min_labels(len(rows), a, b)
    want = sorted((i is None, i or 0, min(rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None)) for k, (i, _) in enumerate(rows))
    assert got == want
    kept = M.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(c for _, _, c in want))
    assert M.near_duplicates(df.limit(0)).count() == 0 and M.keep_first(df.limit(0)).count() == 0


def test_one_row_of_each_component_is_kept(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    names = "doc_id long, text string, h string, head string, th string, n string, fp string"
    kept = lambda rows: [tuple(r) for r in M.keep_first(spark.createDataFrame([(*r, *"vwxyz") for r in rows], names)).select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    # an id that repeats with different texts: both texts stay
    assert sorted(kept([(5, a), (5, b), (7, b)])) == [(5, a), (5, b)]
    # rows that repeat wholly, ids that are null, null and empty texts, a very long text
    rows = [(5, a), (5, a), (None, a), (None, b), (None, b), (3, None), (4, ""), (6, long), (8, long + " tail")]
    assert sorted(kept(rows), key=key) == sorted([(5, a), (None, b), (3, None), (6, long)], key=key)
    # of rows alike in id and text one stays whole
    two = spark.createDataFrame([(1, a, "x", 1), (1, a, "y", 2)], "doc_id long, text string, lang string, k int")
    assert [tuple(r)[2:] for r in M.keep_first(two).collect()] in ([("x", 1)], [("y", 2)])
