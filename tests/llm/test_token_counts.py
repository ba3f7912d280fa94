from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweft.llm import token_counts as M

BITS = st.sampled_from(["a", "B", "é", " ", "  ", "\n", "'s", "'ll", "'r", "'", "1", "23", "!", "...", "😀", "\x1c", "\u2003", "日", "\t", " x"])
TEXT = st.lists(BITS, max_size=40).map("".join)
C = M.Counts(M.read_ranks(M.RANKS))


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), st.lists(BITS, max_size=4).map("".join)), max_size=6))
def test_edits_leave_the_tree_of_the_new_text(text, edits):
    tree = M.Tree(C, text)
    assert tree.tokens == len(C.encoding.encode_ordinary(text))
    for at, n, new in edits:
        a = min(at, len(text))
        b = min(a + n, len(text))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text() == text and tree.chars == len(text)
        assert [p for leaf in tree.parts for p in leaf] == C.expression.findall(text)
        assert tree.tokens == len(C.encoding.encode_ordinary(text))


def test_only_the_neighbourhood_is_encoded_again():
    text = "some words in a row, " * 2000
    tree = M.Tree(C, text)
    tree.edit(20_000, 20_005, "other")
    assert tree.encoded < 60 and tree.tokens == len(C.encoding.encode_ordinary(text[:20_000] + "other" + text[20_005:]))


def apply(text, edits):
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    return text


def test_frames(spark):
    rows = [(1, "Hello   world!!  1234567 times\n\n\nover"), (2, None), (3, ""), (4, "clean text"), (4, "clean text"), (None, "a  b"), (5, "x  " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_tokens_after, r.n_edits) for r in M.count_and_edit(df).collect())
    n = lambda t: len(C.encoding.encode_ordinary(t))
    want = sorted((repr(i), n(t or ""), n(apply(t or "", M.cleaning_edits(t or ""))), len(M.cleaning_edits(t or ""))) for i, t in rows)
    assert got == want
    once = df.select("doc_id", "text").where("doc_id <> 4")
    edits = spark.createDataFrame([(i, a, b, s) for i, t in rows if i in (1, 5) for a, b, s in M.cleaning_edits(t)] + [(1, 6, 9, "overlaps"), (77, 0, 1, "x"), (2, None, 1, "x")], "doc_id long, start long, end long, replacement string")
    stored = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in M.apply_edits(M.trees(once), edits).collect()}
    whole = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in M.count_and_edit(once).collect()}
    assert stored[5] == whole[5] and stored[2] == (0, 0)
    assert M.count_and_edit(df.limit(0)).count() == 0
