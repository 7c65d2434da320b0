import hashlib

import numpy as np
import pytest

from paircraft.llm import minhash


def brute(rows, s):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        f, fe, fn = (minhash.shown(s.minima_of(x)) for x in (t, e, nxt))
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), f.tobytes().hex(), fe.tobytes().hex(),
                  float((f == fe).mean()), float((f == fn).mean()))
    return out


def as_dict(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_fingerprints_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_dict(minhash.fingerprint_edits(docs)) == brute(rows, minhash.Signer())


@pytest.mark.parametrize("n", [0, 1, 9])
def test_fingerprints_edges(spark, n):
    texts = [None, "", "one", "a b c d e f g h", "a b c d e f g h", "é" * 9 + " ñ", "x " * 3000, "a b c d", " \n "]
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)][:n]
    docs = spark.createDataFrame([(*r, "at", 1) for r in rows], "doc_id bigint, text string, at string, ghost int")
    got = minhash.fingerprint_edits(docs.repartition(3))
    assert as_dict(got) == brute(rows, minhash.Signer())
    if n == 9:
        by = as_dict(got)
        assert by[1][2] == by[8][2] and by[-20][2] == by[-13][2] == "ffff" * 128
        assert by[1][5] == 1.0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "n"), (2, None)], "doc_id bigint, text string")
    got = minhash.fingerprint_edits(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 1), ("1", 1), ("1", 1), ("2", 0), ("None", 1)]


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    s = minhash.Signer()
    for share in (0.2, 0.6, 0.9):
        x = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
        y = np.concatenate([x[:int(3000 * share)], rng.integers(0, 1 << 62, 3000 - int(3000 * share)).astype(np.uint64)])
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(minhash.likeness(minhash.shown(s.minima(x)), minhash.shown(s.minima(y))) - j) < 0.15
