"""Texts are read and cut into words once; topics come from the vectors made then."""

import numpy as np

from chronoweft.llm import mixing as M


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, f"some words {i % 7} and {i % 5} more", "xy"[i % 2], "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(path)
    reads, staged = [], M.staged

    def counted(df, name, *more):
        reads.append(any(x.startswith(f"file:{path}") or f"{path}/" in x for x in df.inputFiles()))
        return staged(df, name, *more)

    monkeypatch.setattr(M, "staged", counted)
    out = M.mixed(spark.read.parquet(path))
    assert out.count() == 60 and len(reads) > 1
    assert sum(reads) == 1 and not any(path in x for x in out.inputFiles())


def test_topics_of_all_rows_by_hand(spark):
    """Null, empty and long texts, null and rare languages, repeated ids: the nearest centre of the text's own vector."""
    own = ("ball goal team match", "rate bank loan price")
    rows = [(i, f"The of and {own[i % 2]} {own[i % 2]} n{i % 37}", "s", "en") for i in range(300)]
    rows += [(300, None, "s", "en"), (301, "", None, "de"), (302, "sky tree", "s", None), (302, None, "t", None), (303, " \t\n", "s", "fr")]
    rows += [(304, " ".join(f"w{i}" for i in range(30_000)), "t", "en"), (None, "A\u00a0b C\x0bd", "t", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    fitted = M.fit_topics(docs)
    want = []
    for i, t, s, x in rows:
        words = (t or "").encode().lower().split()
        z = M._vector(words) - fitted.means.get(x, fitted.means[None])
        want.append((str(i), str(s), str(x), int(np.argmax(fitted.centres @ z)), len(words)))
    got = [(str(r.doc_id), str(r.source), str(r.lang), r.topic, r.n_tokens) for r in M.mixed(docs).collect()]
    assert sorted(got) == sorted(want) and len({r[3] for r in got}) > 1


def test_vectors_come_back_from_their_bytes():
    texts = [b"a b c a", b"", None, b"w " * 9, b" ".join(b"x%d" % i for i in range(5000))]
    made = [(None, None) if t is None else M._packed(M._vector(t.split())) for t in texts]
    back = M._dense([x for x, _ in made], [x for _, x in made])
    for t, row in zip(texts, back):
        assert np.array_equal(row, M._vector((t or b"").split())) and row.dtype == np.float32
    assert M._dense([], []).shape == (0, M.DIMS)
