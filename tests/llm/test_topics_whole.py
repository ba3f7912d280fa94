"""Topics are fitted on every text, not on the sample that they start from."""

import numpy as np

from chronoweft.llm import mixing as M


def test_means_and_centres_of_all_texts(spark):
    rows = []
    for i in range(400):
        own = "ball goal team match" if i % 2 else "rate bank loan price"
        rows.append((i, f"the of and {own} {own} n{i % 37}", "en" if i else "xx"))
    rows += [(400, None, "en"), (401, "", "de"), (402, "sky tree", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = M.fit_topics(docs, topics=2, sample=5)
    z = {r[0]: M._vector(r[1].encode().split()) for r in rows if r[1] is not None}
    by = lambda name: np.mean([z[i] for i, t, x in rows if t is not None and x == name], axis=0)
    assert set(got.means) == {"en", "xx", "de", None}
    for name in ("en", "xx", "de"):
        assert np.allclose(got.means[name], by(name), atol=1e-6), name
    assert np.allclose(got.means[None], np.mean(list(z.values()), axis=0), atol=1e-6)
    # a centre is the direction of its own members, all of them
    centred = {i: z[i] - got.means.get(x, got.means[None]) for i, t, x in rows if t is not None}
    own = {i: int(np.argmax(got.centres @ c)) for i, c in centred.items()}
    for k in set(own.values()):
        total = sum(centred[i] / max(np.linalg.norm(centred[i]), 1e-12) for i in own if own[i] == k)
        assert np.allclose(got.centres[k], total / np.linalg.norm(total), atol=1e-5)
