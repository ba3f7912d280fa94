import random
import re

import pytest

from chronoweft.llm import substrings as M

P = "The first long sentence of a passage has quite a few words in it. The second one follows it and has nearly as many words. A third closes it here. "
Q = "Another text begins with words that nobody else has ever used before now. It goes on for a while with more of its own words, and ends. "


END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\s*\n\s*")


def cut(text):
    """Sentences, by another expression than the operator's."""
    out, at = [], 0
    for m in END.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    return out + ([text[at:]] if text[at:] else [])


def brute(rows, words=20):
    """Every run of two or more sentences that has the words, and every single one of 50; no shortest ones."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        if rows[i][1] is None:
            out[i] = None
            continue
        parts = cut(rows[i][1])
        drop = [False] * len(parts)
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                if not parts[a].split() or not parts[b].split():
                    continue
                run = tuple(" ".join(parts[a : b + 1]).lower().split())
                if (b > a and len(run) >= words) or (a == b and len(run) >= 50):
                    if seen.setdefault(run, (i, a)) != (i, a):
                        drop[a : b + 1] = [True] * (b + 1 - a)
        out[i] = "".join(p for p, d in zip(parts, drop) if not d)
    return [out[i] for i in range(len(rows))]


def test_sentences_make_up_the_text():
    for t in ("", "a", "A b. C d!\nE f", P + Q, "  \n\n x.  ", "no end"):
        assert "".join(M.sentences(t)) == t


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60)) + ". "
    rows = [(1, P + Q), (2, Q[:30] + ". " + P), (3, P.upper()), (4, ""), (5, None), (6, long + "Mine. "), (7, "Own start. " + long), (8, P + P), (None, Q)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in M.dedup(df).collect()}
    for (i, _), want in zip(rows, brute(rows)):
        assert got[i].text == want, i
    assert got[1].n_removed == 0 and got[3].text == "" and got[7].text == "Own start. "
    assert got[5].text is None and got[5].n_sentences == 0 and got[4].n_sentences == 0
    a, b = map(int, got[2].removed.split(":"))
    assert rows[1][1][:a] + rows[1][1][b:] == got[2].text


def test_clean_documents_stay_and_columns_are_kept(spark):
    rows = [(1, "Short. One. Two.", "x", 5), (2, "Short. One. Two.", "y", 6), (3, Q, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, n_removed long")
    out = M.dedup(df)
    assert out.columns == ["doc_id", "text", "removed", "n_removed", "n_sentences", "n_removed_1", "removed_1"]
    assert {(r.doc_id, r.text, r.removed, r.n_removed) for r in out.collect()} == set(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, P), (1, P)], "doc_id long, text string")
    assert [r.text for r in M.dedup(df).collect()] == [P, P]
    assert M.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [0, 8, 20])
def test_random_documents_against_every_run(spark, words):
    rnd = random.Random(words)
    bits = [" ".join(rnd.choice("the of a in Cat dog runs far".split()) for _ in range(rnd.randint(1, 9))) + rnd.choice([". ", "! ", "\n", '." ', " "]) for _ in range(14)]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))) for i in range(60)] + [(90, "x y. " * 3000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows[:60]], "doc_id long, text string, __h int, __key int, h int, spans int")
    got = {r.doc_id: r.text for r in M.dedup(df, min_words=words).collect()}
    assert [got[i] for i in range(60)] == brute(rows[:60], words)
    (long,) = M.dedup(spark.createDataFrame([rows[60]], "doc_id long, text string")).collect()
    assert long.n_sentences == 3000 and long.n_removed > 2900 and rows[60][1].startswith(long.text)
