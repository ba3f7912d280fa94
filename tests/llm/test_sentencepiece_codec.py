import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweft.llm import sentencepiece_codec as M

ODD = ["", " ", "  a", "a  ", "\n\n", "\u2581x", "x\u2581", "<s> </s> <unk> <0x0A>", "😀é\u0000\u0001", "a  b   c", " " * 50 + "x", "日本語 テスト", "\t\tif x:\n    y" * 4]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram(trim):
    """A hand-made unigram model; nothing is trained."""
    words = ["\u2581", "\u2581a", "b", "ab", "\u2581ab", "c", "bc", "\u2581abc", "a", "é", "\u2581\u2581"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, "x"), (3, 1), (4, int(trim)), (5, 1))))


@pytest.fixture(scope="module")
def bpe():
    return M.Codec(M.read_model(M.MODEL))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_parity(text):
    c = M.codec(M.read_model(M.MODEL))
    (ids,) = c.encode([text])
    assert ids == c.reference.encode(text) and c.decode([ids]) == [c.reference.decode(ids)]


def test_odd_texts(bpe):
    ids = bpe.encode(ODD)
    assert ids == bpe.reference.encode(ODD) and all(bpe.same_text(ODD, bpe.decode(ids)))
    broken = [[3 + 0xFF], [3 + 0xE2, 3 + 0x82, 500]]
    assert bpe.decode(broken) == [bpe.reference.decode(x) for x in broken]


@pytest.mark.parametrize("trim", [False, True])
def test_unigram_parity(trim):
    c = M.Codec(unigram(trim))
    texts = ["abc ab a b", "  abc   x", "é ñ", "", "cab bca", "aaabbbccc  abc "]
    assert c.encode(texts) == c.reference.encode(texts)


def test_unknown_models_are_refused():
    with pytest.raises(ValueError):
        M.parse(message((1, message((1, "x"), (2, 0.0), (3, 4)))))


def test_frames(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(None, None, None), (3, "again", "k"), (3, "again", "k"), (99, "long word " * 200_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = M.encode(df)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_1", "parity", "round_trip"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip and r.n_tokens == len(r.ids_1) for r in got)
    back = M.decode(out.select("doc_id", "ids_1"), ids="ids_1").collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), (t or "").replace("\u2581", " ")) for i, t, _ in rows)
    assert M.encode(df.limit(0)).count() == 0
