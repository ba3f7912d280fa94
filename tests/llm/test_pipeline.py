import corpus_pipeline as P
from chronoweft.llm import mixing, pii, quality, simhash
from chronoweft.llm.common import min_labels, staged

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in P.STAGES:
        inputs.append(docs)
        docs = staged(stage(spark, docs, DATA), "test")
        if stage is not P.STAGES[-1][1]:
            assert docs.columns == columns, name
    first, second, third, fourth, fifth = ({r.doc_id: r for r in d.collect()} for d in inputs)
    # 1: what the classifier rejects is gone, all else is unchanged
    verdict = {r.doc_id: r.predicted for r in quality.op2_quality_classifier(spark, DATA).collect()}
    assert second == {i: r for i, r in first.items() if verdict[i]}
    # 2: one document of each group, by all pairs of fingerprints
    ids = sorted(second)
    fp = [simhash.fingerprint((second[i].text or "").encode()) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    root = min_labels(len(ids), *(map(list, zip(*links)) if links else ([], [])))
    assert third == {ids[k]: second[ids[k]] for k in sorted(set(root.tolist()))}
    # 3: same documents; texts that hold nothing are unchanged, and lengths agree
    spans = {r.doc_id: len(r.base) + len(r.added) for r in pii.find(inputs[2]).collect()}
    assert set(fourth) == set(third) and all(r.n_chars == len(r.text) for r in fourth.values())
    assert all((fourth[i].text == third[i].text) == (spans[i] == 0) for i in third)
    # 4: the drawn ones, unchanged
    drawn = {r.doc_id for r in mixing.mixed(inputs[3]).collect() if r.kept}
    assert fifth == {i: fourth[i] for i in drawn}
    # 5: tokens of every document left
    last = docs.collect()
    assert {r.doc_id for r in last} == set(fifth) and all(r.parity and r.round_trip and len(r.ids) == r.n_tokens for r in last)
    assert P.run(spark, DATA).count() == len(last)
