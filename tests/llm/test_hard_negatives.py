import numpy as np
import pytest
from pyspark.sql import functions as F

from paircraft.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, score int"


def brute(rows, n_pos=5, n_neg=3, every=50, moved=7):
    """Hard negatives by Python integers."""
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if i % moved == 0:
            label = (label + 1) % 10
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = []
    for a, (la, qa) in kept.items():
        if a % every:
            continue
        score = lambda q: sum(x * y for x, y in zip(qa, q))
        near = sorted((-score(q), i, lab) for i, (lab, q) in kept.items() if i != a)
        for s, p, _ in [x for x in near if x[2] == la][:n_pos]:
            low, high = 50 * -s, 95 * -s
            neg = [(n, -t) for t, n, lab in near if lab != la and low <= 100 * -t <= high]
            out += [(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(neg[:n_neg])]
    return sorted(out)


def rows_of(seed, n=260, width=9, levels=6):
    """Few levels make many ties."""
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(0, levels, width) / 8], int(rng.integers(0, 10)), "x", 1) for i in range(n)]


@pytest.mark.parametrize("shape", [(4096, 16384, 2048, 32), (2, 30, 16, 2)])
def test_equal_to_brute_force(spark, shape, monkeypatch):
    for name, value in zip(("ANCHOR_ROWS", "CANDIDATE_ROWS", "TILE", "FAN"), shape, strict=True):
        monkeypatch.setattr(hn, name, value)
    rows = rows_of(1)
    rows += [(500, [0.1] * 9, None, "x", 1), (501, None, 3, "x", 1), (502, [0.1] * 8 + [None], 3, "x", 1), (503, [float("nan")] * 9, 3, "x", 1),
             (504, [float("inf")] * 9, 3, "x", 1), (None, [0.5] * 9, 3, "x", 1), rows[50], rows[3], (150, [0.9] * 9, 0, "x", 1)]
    got = sorted(tuple(r) for r in hn.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    want = brute(rows)
    assert len(want) > 40 and got == want


def test_a_third_in_one_label_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hn, "CANDIDATE_ROWS", 40)
    rows = [(i, v if i % 3 else [0.5] * 9, lab if i % 3 else 4, "x", 1) for i, v, lab, *_ in rows_of(2)]
    got = sorted(tuple(r) for r in hn.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute(rows) and got


def test_general_interface_empty_and_large(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.9, 0.1]), (4, [0.6])], "id int, v array<double>")
    got = hn.mine(df, "id", "v", label=F.when(F.col("id") <= 2, 0).otherwise(1), n_pos=1, n_neg=1)
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in got.collect()} == {(1, 2, 3), (2, 1, 3)}  # a short vector is padded with zeros
    assert hn.report(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ArithmeticError):
        hn.mine(spark.createDataFrame([(1, [1e30], 1)], "id long, v array<double>, label int"), "id", "v")


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for m, k, n in [(1, 1, 1), (9, 33, 17), (64, 64, 64), (31, 100, 90)]:
        a, b = rng.integers(-2 ** 20, 2 ** 20, (m, k)), rng.integers(-2 ** 20, 2 ** 20, (k, n))
        assert np.array_equal(hn.strassen(a, b), a.astype(object) @ b.astype(object))
    assert hn.strassen(np.empty((0, 5), np.int64), np.empty((5, 3), np.int64)).shape == (0, 3)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(4)
    heap = lambda n: (rng.integers(0, 5, n), rng.integers(0, 4, n), rng.permutation(1000)[:n])
    parts = [heap(30) for _ in range(4)]
    whole = hn.merged(parts, 3)
    step = hn.merged([hn.merged(parts[:2], 3), hn.merged(parts[2:], 3)], 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, step, strict=True))
    for s in range(5):
        every = sorted((-int(x), int(i)) for p in parts for slot, x, i in zip(*p) if slot == s)[:3]
        assert [(-int(x), int(i)) for slot, x, i in zip(*whole) if slot == s] == every
