"""Byte-level BPE by a sentencepiece model that is written from a rank file.

The rank file (one base64 byte string and its rank per line) becomes the
protobuf message of a sentencepiece BPE model: every byte string is a piece
over 256 printable stand-ins, its score is the negative rank, so that the
lowest rank merges first, and the normaliser is the identity. Texts are split
by the vocabulary's public pattern, each distinct match is encoded once per
task, and ids are decoded by the inverse table.

Null and empty texts have no ids; equal texts have equal ids; other columns of
the input are left alone. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from paircraft.llm.common import CACHE_ENTRIES, slices

VOCAB = "byte_bpe_multi_50k.tiktoken"
#: Fixed values of the sentencepiece model format: piece types and the BPE model type.
NORMAL, UNKNOWN, BPE = 1, 2, 2


def stand_ins() -> str:
    """256 printable characters, one per byte: printable Latin-1 bytes stand
    for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, floats 32-bit, the rest varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """The sentencepiece model: a piece's id is its rank; the unknown piece,
    which the format asks for and no text reaches, comes last."""
    table = stand_ins()
    shown = lambda t: "".join(table[b] for b in t).encode()
    pieces = [_field(1, shown(t)) + _field(2, -float(r)) + _field(3, NORMAL) for r, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    none = (1 << 64) - 1  # -1: the model has no such id
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(
        _field(k, none) for k in (41, 42, 43))
    identity = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one vocabulary, with a bounded cache of matches."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(stand_ins())}
        self.cache: dict[str, bytes] = {}

    def _learn(self, new: Iterable[str]) -> None:
        new = list(new)
        shown = [m.encode().decode("latin-1").translate(self.table) for m in new]
        for m, ids in zip(new, self.model.encode(shown, out_type=int, num_threads=1), strict=True):
            self.cache[m] = np.array(ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        matches = [self.find(t) if t else [] for t in texts]
        self._learn(set().union(*matches) - self.cache.keys())
        get = self.cache.__getitem__
        return [b"".join(map(get, m)) for m in matches]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<bigint>) of every row. ``vocab`` is a rank file that the
    executors can open; by default the public one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocab or public_tokenizers.path(VOCAB))
        for b in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in coder.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<bigint>")


def decode(encoded: DataFrame, vocab: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from ``encode``'s rows; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocab or public_tokenizers.path(VOCAB))
        for b in slices(batches):
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace")
                     for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digests of ids and of the bytes decoded from them, per row; the ids
    themselves never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocab or public_tokenizers.path(VOCAB))
        for b in slices(batches):
            ids = coder.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
