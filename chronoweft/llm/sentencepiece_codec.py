"""SentencePiece models on the ``tokenizers`` library.

The model file's protobuf is read here, field by field; normaliser, white-space
marker, scores (or merges) and byte fallback are rebuilt as a ``tokenizers``
pipeline, and texts are encoded in multithreaded batches.  Parity with the
``sentencepiece`` library is verified on the rows themselves.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Where the registered query finds its model (a parameter of every function).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of text that are encoded at a time.
SLICE_CHARS = 1 << 20


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 0x7F) << shift
        i += 1
        if b[i - 1] < 0x80:
            return out, i
        shift += 7


def fields(b: bytes):
    """(number, value) of every field of a protobuf message; nested ones stay bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = b[i : i + size], i + size
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield key >> 3, value


def parse(blob: bytes) -> Model:
    """Read a model file."""
    m = Model()
    for number, value in fields(blob):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 24:
                    m.whitespace_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if m.whitespace_as_suffix or any(k == USER_DEFINED for _, _, k in m.pieces):
        raise ValueError("user-defined pieces and suffixed white space are not supported")
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first, as a BPE model has them."""
    rank = {p: (-s, i) for i, (p, s, k) in enumerate(m.pieces) if k == NORMAL}
    found = []
    for p, r in rank.items():
        for cut in range(1, len(p)):
            a, b = p[:cut], p[cut:]
            if a in rank and b in rank:
                found.append((r, rank[a], rank[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(m: Model):
    """The ``tokenizers.Tokenizer`` of a model.

    Normaliser: the model's character map, white-space rules and dummy prefix.
    The marker is set by the metaspace pre-tokenizer, which does not split, and
    taken back by the metaspace decoder.  The prefix's space stays in decoded
    texts; :class:`Codec` takes it off.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_whitespaces else " "))
    if m.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        unk = m.pieces[m.unk_id][0]
        model = models.BPE(vocab, merges_of(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=100_000)
    else:
        # Control and byte pieces are never found in a text; a score no path can afford keeps them out.
        scores = [(p, s if k == NORMAL else -1e9) for p, s, k in m.pieces]
        model = models.Unigram(scores, m.unk_id, m.byte_fallback)
    t = Tokenizer(model)
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if m.escape_whitespaces:
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=False)
    t.decoder = decoders.Sequence([decoders.Metaspace(replacement=MARK, prepend_scheme="never"), decoders.ByteFallback()])
    return t


class Codec:
    """A model ready for batches of texts, and the library that it is verified against."""

    def __init__(self, blob: bytes):
        import sentencepiece

        m = parse(blob)
        self.tokenizer = build(m)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.prefix = m.add_dummy_prefix
        #: The normaliser changes nothing but spaces to markers.
        self.plain = m.escape_whitespaces and not m.charsmap and not m.remove_extra_whitespaces

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        made = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if t[:1] == " " else t for t in made] if self.prefix else made

    def same_text(self, texts: list[str], decoded: list[str]) -> list[bool]:
        """Whether the decoded texts are the normalised ones."""
        if not self.plain:
            texts = [self.reference.decode(self.reference.encode(t)) for t in texts]
        return [t == d or t.replace(MARK, " ") == d for t, d in zip(texts, decoded)]


_codecs: dict[bytes, Codec] = {}


def codec(blob: bytes, threads: int = 1) -> Codec:
    """The codec of a model's bytes; built once in a worker, with a library pool of ``threads``."""
    if blob not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _codecs.clear()
        _codecs[blob] = Codec(blob)
    return _codecs[blob]


def threads_of(docs: DataFrame) -> int:
    """Threads of a task's library pools: ``spark.task.cpus``, two at least."""
    return max(2, int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def slices(texts: list[str], most: int = SLICE_CHARS):
    """Bounds of runs of texts with about ``most`` characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", verify: bool = True) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids``, ``parity`` and ``round_trip``.

    ``model`` is a path that the driver reads; its bytes travel with the task.
    With ``verify``, ``parity`` says whether the ``sentencepiece`` library gives
    the same ids, ``round_trip`` whether decoding the ids gives the normalised
    text; without, both are null.  A task's library threads follow ``spark.task.cpus``, two at least.  Null texts count as empty:
    no ids.  Rows that repeat stay, other columns are carried along, and where
    they have one of the new names the new column is numbered.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(read_model(model))
    keep = [c for c in docs.columns if c != text]
    names = []
    for n in ("n_tokens", "ids", "parity", "round_trip"):
        names.append(fresh([*keep, *names], n))
    schema = docs.select(*keep).schema
    for n, kind in zip(names, (T.IntegerType(), T.ArrayType(T.IntegerType()), T.BooleanType(), T.BooleanType())):
        schema = schema.add(n, kind)

    threads = threads_of(docs)

    def run(batches):
        c = codec(blob.value, threads)
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            ids, parity, back = [], [], []
            for i, j in slices(texts):
                some = texts[i:j]
                got = c.encode(some)
                ids.append(pa.array(got, pa.list_(pa.int32())))
                if verify:
                    want = c.reference.encode(some, num_threads=threads)
                    parity += [x == y for x, y in zip(got, want)]
                    back += c.same_text(some, c.decode(got))
                else:
                    parity += [None] * (j - i)
                    back += [None] * (j - i)
            made = pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))
            n = made.value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), n, made, pa.array(parity, pa.bool_()), pa.array(back, pa.bool_())],
                names=[*keep, *names],
            )

    return docs.select(*keep, F.col(text).cast("string").alias(fresh(keep, "text"))).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the ids replaced by the decoded ``text``; null ids give a null text."""
    small_batches(tokens.sparkSession)
    blob = tokens.sparkSession.sparkContext.broadcast(read_model(model))
    keep = [c for c in tokens.columns if c != ids]
    name = fresh(keep, text)
    schema = tokens.select(*keep).schema.add(name, "string")

    threads = threads_of(tokens)

    def run(batches):
        c = codec(blob.value, threads)
        for b in batches:
            lists = b.column(len(keep)).to_pylist()
            made = c.decode([x or [] for x in lists])
            made = [None if x is None else t for x, t in zip(lists, made)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(made, pa.string())], names=[*keep, name])

    return tokens.select(*keep, F.col(ids).alias(fresh(keep, "ids"))).mapInArrow(run, schema)


def op3_sentencepiece_encode_decode(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, parity, round_trip of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs.select("doc_id", "text"))
