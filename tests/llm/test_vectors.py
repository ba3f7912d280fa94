import numpy as np
import pytest

from chronoweft.llm import ann, embdedup
from chronoweft.llm.common import min_labels

RND = np.random.default_rng(4)


def cloud(n, dim=8, groups=4, size=6, noise=0.02):
    x = RND.standard_normal((n, dim))
    for g in range(groups):
        at = RND.choice(n, size, replace=False)
        x[at] = x[at[0]] + noise * RND.standard_normal((size, dim))
    x[3] = x[7]
    x[11] = 2 * x[7]
    return x


ODD = [(901, None, 1), (902, [], 1), (903, [0.0] * 8, 1), (904, [float("nan")] + [1.0] * 7, 1), (905, [1.0, None] + [1.0] * 6, 1), (906, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (907, [1.0] * 8, None)]


def test_near_duplicates_are_brute_force(spark):
    x = cloud(260)
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)] + [(9, [float(v) for v in x[9]], 1)] + ODD
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    ids, lab = np.array([r[0] for r in rows[:261]]), np.array([r[2] for r in rows[:261]])
    y = np.array([r[1] for r in rows[:261]])
    c = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    link = (c >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(261, dtype=bool)
    root = min_labels(261, *np.nonzero(link))
    low = [min(ids[root == root[i]]) for i in range(261)]
    want = sorted((int(ids[i]), int(link[i].sum()), int(low[i]), bool(ids[i] == low[i])) for i in range(261))
    for how in ({}, {"leaf": 40, "sample": 80, "trees": 8}, {"leaf": 40, "sample": 80, "upper_sample": 0}):
        got = embdedup.near_duplicates(df, **how).collect()
        known = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id < 900)
        if "leaf" in how:  # links may be missed, none is made up
            assert sum(r[1] for r in known) >= 0.9 * sum(r[1] for r in want)
            assert all(a[1] <= b[1] for a, b in zip(known, want))
        else:
            assert known == want
        rest = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id >= 900]
        assert sorted(map(repr, rest)) == sorted(repr((i, 0, i, None if i is None else True)) for i, *_ in ODD)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", [{}, {"leaf": 100, "sample": 400}, {"upper_sample": 0}])
def test_recall_of_links_with_splits(spark, how):
    n, dim = 6000, 24
    x = RND.standard_normal((n, dim))
    pairs = RND.permutation(n)[:3000].reshape(-1, 2)
    for a, b in pairs:  # cosines from 0.98 up
        x[b] = x[a] + RND.uniform(0.02, 0.19) * np.linalg.norm(x[a]) * (d := RND.standard_normal(dim)) / np.linalg.norm(d)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = np.argwhere(np.triu(u @ u.T >= 0.98, 1))
    got = {r.vec_id: r.n_links for r in embdedup.near_duplicates(df, **how).collect()}
    assert len(links) > 1000 and sum(got.values()) <= 2 * len(links)
    assert sum(got.values()) >= 0.99 * 2 * len(links)


def test_a_clump_is_compared_in_blocks(spark):
    x = np.ones((300, 8)) + 0.01 * RND.standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embdedup.near_duplicates(df, leaf=50, sample=100, block=50).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}
    # a third of all rows in a clump, the rest apart
    y = np.concatenate((x, 3 * RND.standard_normal((600, 8))))
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(y)], "vec_id long, embedding array<double>, label int")
    some = [r.n_links for r in embdedup.near_duplicates(df, leaf=50, sample=200, block=100).where("vec_id < 300").collect()]
    assert np.mean(some) >= 0.95 * 299


@pytest.mark.parametrize("how", [{"probe": 1.0}, {"probe": 1.0, "block_rows": 20, "chunk": 2}, {"centroids": 8}])
def test_search(spark, how):
    x = cloud(400)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(5, [float(v) for v in x[5]], 0)] + ODD[:-1]  # the last takes part in a search
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df, every=25, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    recall = []
    for q in range(0, 400, 25):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        recall.append(len(set(order) & {i for i, _ in got[q]}) / 10)
        if "probe" in how:
            assert [i for i, _ in got[q]] == order and np.allclose([s for _, s in got[q]], d[order], rtol=0, atol=1e-12)
    assert len(got) == 16 and np.mean(recall) >= 0.9


def test_recall_on_the_production_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        recall.append(len(set(ids[np.lexsort((ids, d))[:10]]) & got[ids[q]]) / 10)
    assert np.mean(recall) >= 0.9


def test_search_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert ann.search(spark.createDataFrame([], kind)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0]), (8, [5.0])], kind)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 3, 0.0), (0, 2, 7, 0.0)]


def test_the_share_to_visit_follows_the_structure():
    plain = RND.standard_normal((4000, 32))
    groups = np.repeat(RND.standard_normal((200, 32)), 20, axis=0) + 0.05 * RND.standard_normal((4000, 32))
    share = [ann.probe_for(ann.Codebooks(x, 32), x, 0.95, 10) for x in (plain, groups)]
    assert share[1] < 0.05 < 0.2 < share[0] <= 1
    assert ann.probe_for(ann.Codebooks(plain[:1], 8), plain[:1], 0.95, 10) == 1.0


def test_an_id_repeated_near_a_query_does_not_crowd_out_others(spark):
    x = cloud(60)
    q = [float(v) for v in x[0]]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x[:20])]
    rows += [(77, [v + 0.001 * k for v in q]) for k in range(30)] + [(77, [float(v) for v in r]) for r in x[40:]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ({}, {"probe": 0.01, "centroids": 16}):
        got = [r.vec_id for r in ann.search(df, every=100, **how).orderBy("rank").collect()]
        assert len(got) == len(set(got)) == 10 and got[0] == 77
    few = ann.search(df.where("vec_id IN (0, 3, 77)"), probe=0.01).collect()
    assert {r.vec_id for r in few} == {3, 77}
