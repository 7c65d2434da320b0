import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paircraft.llm import ngram_lm


def brute(rows, order, mu=ngram_lm.MU, discount=ngram_lm.DISCOUNT):
    """Dictionary automaton, token by token."""
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = [[w for w in (t or "").encode().lower().split()] + [1] for _, t in rows]
    counts, state = [Counter() for _ in range(order)], defaultdict(int)
    for (d, _), ts in zip(rows, toks, strict=True):
        if not out(d):
            padded = [2] * order + ts
            for i in range(order, len(padded)):
                for k in range(order):
                    counts[k][tuple(padded[i - k:i + 1])] += 1
                for k in range(1, order):
                    state[tuple(padded[i - k:i])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    res = []
    for (d, _), ts in zip(rows, toks, strict=True):
        padded, score, base = [2] * order + ts, 0.0, 0.0
        for i in range(order, len(padded)):
            c = counts[0][(padded[i],)]
            base += math.log10((c + 1) / (n + v + 1))
            p = 1.0 if not n else (c - discount) / n if c else discount * v / n
            for k in range(1, order):
                arc = counts[k][tuple(padded[i - k:i + 1])]
                p = (arc + mu * p) / (state[tuple(padded[i - k:i])] + mu)
            score += math.log10(p)
        res.append((d, out(d), len(ts), sum(counts[0][(x,)] > 0 for x in ts), n, base, score))
    return sorted(res, key=str)


def close(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


ROWS = [(i, t) for i, t in enumerate([None, "", "a b a b c", "A B a b C", "the cat", "the cat", "x " * 4000, " \n", "é ñ a b",
                                      "unseen words here", "a", "b a b a", "the the the cat sat"] * 3)] + [(None, "a b"), (3, "A B a b C")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, tmp_path, order):
    docs = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id bigint, text string, block int, k string").repartition(3)
    docs.write.parquet(path := str(tmp_path / "docs"))
    close(ngram_lm.scores(spark.read.parquet(path), order=order).collect(), brute(ROWS, order))


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_lm.scores(docs).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "a b") for i in held]
    close(ngram_lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect(), brute(rows, 2))


def test_table_beats_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ngram_lm.scores(docs).collect()
    close(got, brute([(r.doc_id, r.text) for r in docs.collect()], 2))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def small(order, texts=("a b a c", "a b", "b"), training=(True, True, False)):
    codes = ngram_lm.WordCodes()
    block = ngram_lm.Block([codes.of(t.encode().split()) for t in texts], list(training), order)
    totals, at = [], []
    for grams in block.grams:
        keys, place, _, _ = ngram_lm.distinct(grams, 1)
        totals.append(np.bincount(place[block.training], minlength=len(keys)))
        at.append(place)
    n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
    return block, at, ngram_lm.Automaton(block, totals, at, n, v, sum(training), ngram_lm.MU, ngram_lm.DISCOUNT)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_arcs_and_failure_arcs(order):
    block, at, auto = small(order)
    assert (np.diff(auto.arc_key) > 0).all()  # one arc per state and token
    state = np.arange(len(auto.fail_target))
    for _ in range(order):  # failure arcs end at the empty history
        state = auto.fail_target[state]
    assert not state.any() and (auto.fail_weight <= 0).all() and auto.fail_weight[0] == 0
    # from every state that an arc leads to, the tokens' probabilities add up to 1 with one class of unknown words
    for s in {0, *auto.arc_target.tolist()}:
        tokens = np.arange(auto.words)
        known = 10 ** auto.step(np.full(len(tokens), s), tokens)[1]
        assert known.sum() <= 1 + 1e-9


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_stretches_carry_the_state(order):
    text = "a b c a b a c c b a b c " * 5
    block, at, auto = small(order, (text, "a", "", text + "b"), (True, True, True, False))
    whole = auto.traverse(block, at[0], 10 ** 6)
    for stretch in (order, 7, 20):
        assert np.allclose(auto.traverse(block, at[0], stretch), whole)
