"""A labelled text of any length is fitted on all its terms."""

import numpy as np

from chronoweft.llm import quality as M


def test_long_labelled_text_is_fitted_as_it_is_scored(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    assert len(M.terms(long.encode())[0]) > 4096
    texts = {i: long if i == 0 else f"plain words {i} of text number {i % 7}" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    kept = [r[0] for r in labels.where(~M.held_out(labels.doc_id)).collect()]
    docs = docs.replace(long, "short") if 0 not in kept else docs
    if 0 not in kept:  # the long text belongs to a row that is fitted
        docs = spark.createDataFrame([(i, long if i == kept[0] else t if i else "short") for i, t in texts.items()], "doc_id long, text string")
    space = M.fit(docs, labels)
    assert np.abs(space.vectors - space.project([long.encode()])).max(axis=1).min() < 1e-4
