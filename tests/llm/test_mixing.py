import re
import struct

import xxhash
import numpy as np

from chronoweft.llm import mixing as M

DATA = "/root/testdata/sf0.01"


def test_raking_meets_all_marginals():
    rnd = np.random.default_rng(3)
    codes = [rnd.integers(0, k, 200) for k in (5, 3, 4)]
    tokens = rnd.integers(1, 1000, 200).astype(float)
    targets = []
    for c in codes:
        s = np.bincount(c, tokens) ** 0.8
        targets.append(s / s.sum())
    p = M.rake(codes, tokens, targets, 0.4)
    assert (p <= 1).all() and (p > 0).all()
    for c, t in zip(codes, targets):
        made = np.bincount(c, p * tokens)
        assert np.abs(made / made.sum() - t).max() < 1e-4
    assert abs((p * tokens).sum() / tokens.sum() - 0.4) < 1e-4


def test_both_ways_agree_and_draws_follow(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    key = lambda df: {r.doc_id: (r.source, r.lang, r.topic, r.n_tokens, round(r.probability, 9), r.kept) for r in df.collect()}
    a = key(M.mixed(docs))
    assert a == key(M.mixed(docs, max_cells=2)) and len(a) == 300
    assert {r.doc_id for r in M.keep_mixed(docs).collect()} == {i for i, v in a.items() if v[5]}
    share = np.mean([v[5] for v in a.values()])
    want = np.array([v[4] for v in a.values()])
    assert abs(share - want.mean()) < 4 * np.sqrt((want * (1 - want)).sum()) / len(want) + 1e-9


def test_given_targets(spark):
    rows = [(i, "one two three four", "xy"[i % 4 == 0], "en", i % 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    out = M.mixed(docs, {"source": {"x": 0.5, "y": 0.5}, "lang": 1.0, "topic": 0.5}, 0.3, topic="topic").collect()
    by = {}
    for r in out:
        by[r.source] = by.get(r.source, 0) + r.probability * r.n_tokens
    assert abs(by["x"] / (by["x"] + by["y"]) - 0.5) < 1e-6


def test_edges(spark):
    rows = [(1, None, None, None, 1), (2, "", "s", "en", 2), (2, "", "s", "en", 2), (None, "some words", "s", None, 3), (3, "word " * 100_000, "t", "de", 4)] + [(i, f"a few words {i}", "s", "en", 0) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h long")
    out = M.mixed(docs).collect()
    assert len(out) == len(rows) and all(r.probability is not None and 0 <= r.probability <= 1 for r in out)
    assert len({r.kept for r in out if r.doc_id == 2}) == 1
    kept = M.keep_mixed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert M.mixed(docs.limit(0)).count() == 0


def test_the_query_against_plain_python(spark):
    """Tokens, targets, raking and draws of op5_mixing, from the texts alone but for the topics."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in M.op5_mixing(spark, DATA).collect()}
    assert set(rows) == set(docs)
    cells = {}
    for i, d in docs.items():
        n = len(re.findall(r"[^ \t\n\x0b\x0c\r]+", d.text or ""))
        assert rows[i].n_tokens == n and (rows[i].source, rows[i].lang) == (d.source, d.lang) and 0 <= rows[i].topic < M.TOPICS
        key = (d.source, d.lang, rows[i].topic)
        cells[key] = cells.get(key, 0) + n
    total = sum(cells.values())
    targets = []
    for m in range(3):
        sums = {}
        for k, n in cells.items():
            sums[k[m]] = sums.get(k[m], 0) + n
        raised = {v: (n / total) ** 0.7 for v, n in sums.items()}
        targets.append({v: x / sum(raised.values()) * total / 2 for v, x in raised.items()})
    p = dict.fromkeys(cells, 0.5)
    for _ in range(200):
        for m in range(3):
            have = {}
            for k, n in cells.items():
                have[k[m]] = have.get(k[m], 0) + p[k] * n
            p = {k: min(1.0, x * targets[m][k[m]] / have[k[m]]) for k, x in p.items()}
    for i, r in rows.items():
        assert abs(r.probability - p[r.source, r.lang, r.topic]) < 1e-4
        h = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(str(i).encode(), 42))
        assert r.kept == ((h >> 11) / 2**53 < r.probability)


def test_columns_of_any_name(spark):
    rows = [(i, f"some words {i} and more", "xy"[i % 2], "en", "a", "b", "c", "d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __h string, __id string, id string, text_hash string")
    kept = M.keep_mixed(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} < set(rows)
