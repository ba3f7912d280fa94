import zlib

import numpy as np

from chronoweft.llm import quality as M

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in M.op2_quality_classifier(spark, DATA).collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in rows]
    held = [(r.predicted, q) for r, q in labels if r.held_out]
    assert np.mean([p == q for p, q in held]) >= 0.95
    assert all(p == 1 for p, q in held if q == 1)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(M.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = M.fit(docs, labels, max_labelled=100), M.fit(docs, flipped, max_labelled=100)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_blocked_scores_are_the_exact_vote():
    rnd = np.random.default_rng(0)
    s = M.Space(np.zeros((M.DIMS, 4), np.float32), M.unit(rnd.standard_normal((90, 4))), rnd.integers(0, 2, 90).astype(float), rnd.uniform(0.5, 2, 90), 0.7)
    z = M.unit(rnd.standard_normal((300, 4)))
    z[5] = 0
    got = s.score(z)
    for i in range(300):
        c = s.vectors @ z[i]
        near = np.argsort(-c)[: M.NEIGHBOURS]
        w = np.maximum(c[near], 0) ** M.SHARPNESS * s.weights[near]
        assert abs(got[i] - ((w * s.labels[near]).sum() / w.sum() if i != 5 else 0.7)) < 1e-9


def test_edges(spark):
    good = "The and of to a in is it that was. " * 3
    docs = [(i, good + f"w{i}", "s") for i in range(40)] + [(i, "JUNK!! " * 20, "s") for i in range(40, 60)] + [(60, None, None), (61, "", "s"), (61, "", "s"), (None, good, "s"), (62, good * 5000, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)] + [(None, 1, 0), (999, 0, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    space = M.fit(df, labels)
    out = M.scored(df, space, keep=["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "held_out", "score_1", "predicted"] and out.count() == len(docs)
    by = {r.doc_id: r for r in out.collect()}
    assert by[62].predicted == 1 and by[45].predicted == 0 and by[60].score_1 == space.prior and by[None].held_out is False
    assert M.keep_good(df, labels).columns == df.columns
    none = M.fit(df, labels.limit(0))
    assert {r.score_1 for r in M.scored(df, none, keep=["doc_id", "score"]).collect()} == {0.5}
    assert M.scored(df.limit(0), space).count() == 0
