import random
from hashlib import sha256

import numpy as np
import pytest

from paircraft.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, id string, tie int, kept int"


def brute(rows, length=100):
    """By a set of all windows; rows of one id and text are one document."""
    seen, out = set(), {}
    key = lambda r: (r[0] is not None, r[0] or 0, sd.zlib.crc32((r[1] or "").encode()))
    for r in sorted(rows, key=key):
        if (r[0], r[1] or "") in out:
            continue
        t = (r[1] or "").encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        spans = int((gone & ~np.r_[False, gone[:-1]][:len(gone)]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[r[0], r[1] or ""] = (r[0], len(t), int(gone.sum()), spans, sha256(kept).hexdigest())
    return sorted((out[r[0], r[1] or ""] for r in rows), key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(3)]
    rows = []
    for i in range(50):
        parts = [text(rng.randrange(60))]
        if i % 2:
            parts += [rng.choice(passages)[rng.randrange(30):], text(rng.randrange(30))]
        rows.append(" ".join(parts))
    rows += [rows[1], rows[1], rows[1][:200] + "X" + rows[1][200:], "ab " * 200, "a" * 450, "a" * 99, "a" * 100, "", None, passages[0] * 3, "é" * 130]
    return [(i, t, "x", 1, 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("runs, block", [(8192, 16 << 20), (3, 2000)])
def test_equal_to_brute_force(spark, runs, block, monkeypatch):
    """With small regions, anchors are parted again by longer ones."""
    for name, value in (("REGION_RUNS", runs), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(sd, name, value)
    rows = corpus()
    rows += [rows[5], (None, rows[7][1], "x", 1, 1), (4, "other " + rows[9][1], "x", 1, 1), (4, "other " + rows[9][1], "x", 1, 1), (60, rows[1][1] * 40, "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in sd.report(df).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_spans_and_kept_bytes(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, t, "x", 1, 1), (2, "start-" + t + "-end", "x", 1, 1), (3, t[:99], "x", 1, 1)]
    got = {r.doc_id: r for r in sd.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bytes(got[1].kept).decode() == t and got[1].spans == []
    assert bytes(got[2].kept) == b"start--end" and [(s.start, s.end) for s in got[2].spans] == [(6, 6 + len(t))]
    assert bytes(got[3].kept).decode() == t[:99]
    assert sd.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_longest_previous_factor():
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice([8, 9, 16, 100])
        n = rng.randrange(length, 260)
        text = bytes(rng.choice(b"ab") for _ in range(n))
        if rng.random() < 0.4:
            text = (text[:20] * 20)[:n]
        starts = np.arange(n - length + 1)
        got = sd.longest_previous(text, starts, length)
        for s in starts.tolist():
            best = 0
            for q in range(s):
                k = 0
                while k < length and text[q + k] == text[s + k]:
                    k += 1
                best = max(best, k)
            assert got[s] == best


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    texts = [a, b"zz" + a[50:300] + b"yy", a[:100], b"q" * 300]
    for gram in sd.GRAMS:
        owner, start, n, anchor, code = sd.runs(texts, gram)
        of, run = {}, {}
        for o, s, k, x, c in zip(owner.tolist(), start.tolist(), n.tolist(), anchor.tolist(), code.tolist()):
            inside = [texts[o][i:i + 100] for i in range(s, s + k)]
            assert len(set(inside)) == k  # no two windows of a run are equal
            assert all(of.setdefault(w, x) == x for w in inside)
            assert run.setdefault(c, texts[o][s:s + k + 99]) == texts[o][s:s + k + 99]
        assert n.sum() == sum(len(t) - 99 for t in texts)


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(4)
    texts = [(i, 0, "".join(rng.choice("abc ") for _ in range(n)).encode()) for i, n in enumerate((1000, 100, 99, 350))]
    whole = sd.all_runs(texts, 32, 100)
    monkeypatch.setattr(sd, "CHUNK", 130)
    parts = sd.all_runs(texts, 32, 100)

    def anchors(found):
        return {(o, w): a for o, s, n, a, _ in zip(*(x.tolist() for x in found), strict=True) for w in range(s, s + n)}
    assert anchors(whole) == anchors(parts) and len(anchors(whole)) == 901 + 1 + 251
