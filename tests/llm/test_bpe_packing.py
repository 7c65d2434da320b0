import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from paircraft.llm import bpe, packing

TEXTS = ["Hello  world!\n\nIt's 2024, naïve café — ñandú", None, "", " ", "a" * 5000, "\x00\x01\t\r\n x",
         "日本語 текст 🙂🙂", "▁ under ▁▁", "the the the", "the the the", "<|endoftext|> <unk>"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")


def reference_encoding():
    path = public_tokenizers.path(bpe.VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, docs):
    enc = reference_encoding()
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    e = bpe.encode(docs)
    assert {r.doc_id: r.text for r in bpe.decode(e).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_bpe_on_table(spark):
    enc = reference_encoding()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(rows).collect()}
    for r in rows.collect():
        assert got[r.doc_id] == enc.encode_ordinary(r.text or "")


def check_pieces(rows, ids_of, window):
    """Every id in one piece, gapless offsets, no window overfull; returns windows' fills."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_of[d])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[d][p.start:at], "<u4").tobytes())
        assert at == len(ids_of[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return [sum(p.length for p in ps) for ps in by_seq.values()]


def test_packing_exact_and_tight(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows.collect()}
    fills = check_pieces(packing.pack(rows).collect(), ids, 4096)
    assert sum(f < 4096 for f in fills) <= rows.rdd.getNumPartitions()


def test_packing_edges(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    check_pieces(packing.pack(docs, window=16).collect(), ids, 16)
    assert packing.pack(docs.limit(0)).count() == 0
    assert [packing.pad_to(n) for n in (1, 3, 2048, 2049, 4096)] == [1, 4096, 2048, 4096, 4096]


def test_placement_minimises_squares():
    rng = np.random.default_rng(3)
    p = packing.Packer(0, window=64, max_open=10**6)
    for i in range(400):
        size = int(rng.integers(1, 64))
        before = p.level.copy()
        options = {}
        for h in range(0, 64 - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + size < 64:
                    after[h + size] += 1
                options[h] = int((after ** 2).sum())
        p.add(i, b"\0" * 4 * size)
        assert int((p.level ** 2).sum()) == min(options.values())
        assert all(len(p.open[h]) == p.level[h] for h in range(64))


def test_special_tokens_in_other_cases(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
    texts = ["a <|ENDOFTEXT|> b", "x<|EndOfText|>", "<|StartOfText|> A", "a <|endoftext|> B", "ENDOFTEXT"]
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check_pieces(packing.pack(rows).collect(), ids, 4096)


def test_a_batch_does_not_walk_the_remembered_words():
    """What a batch costs must not grow with the words seen before it."""
    class Remembered(dict):
        def walked(self, *_):
            raise AssertionError("walks all remembered words")
        keys = items = values = __iter__ = walked

    coder = packing.WordBpe(public_tokenizers.path(packing.VOCAB))
    coder.cache = Remembered(coder.cache)
    texts = ["Plain words, plain words.", None, "", "née x1-y2 <|ENDOFTEXT|>", "words née"]
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
    for _ in range(2):
        for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
