import random
import time

from paircraft.functions import edit
from paircraft.operators import experts
from paircraft.sources import metric_log


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return len(a) + len(b) - 2 * row[-1]


def test_distance_equals_the_table():
    rng = random.Random(0)
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(40)))
        b = list(a) if rng.random() < 0.5 else [rng.choice("abé") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé"))
        b = "".join(b)
        d = dp(a, b)
        assert edit.indel_distance(a, b) == d == len(a) + len(b) - 2 * edit.lcs_length(a, b)
        assert edit.diagonal_distance(a, b, d) == d
        assert d == 0 or edit.diagonal_distance(a, b, d - 1) is None
    assert edit.indel_ratio("", None) == 1.0 and edit.indel_ratio("a", "") == 0.0


def test_near_copies_cost_their_distance():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    b = list(a)
    for _ in range(20):
        b[rng.randrange(len(b))] = "z"
    start = time.time()
    assert edit.indel_distance(a, "".join(b)) == 40
    assert time.time() - start < 2


def test_text_ratios_once_per_pair_of_texts(spark):
    q = spark.createDataFrame([("k1", "a b c"), ("k2", "a b d"), ("k3", " ")], "qkey string, question string")
    keys = spark.createDataFrame([("1", "k1", "k2"), ("2", "k2", "k1"), ("3", "k1", "k1"), ("4", "k3", "k3")], "pair_id string, qkey1 string, qkey2 string")
    got = {r.pair_id: (r.edit, r.token_set) for r in experts.text_ratios(keys, q).collect()}
    want = edit.indel_ratio("a b c", "a b d"), edit.token_set_ratio("a b c", "a b d")
    assert got == {"1": want, "2": want, "3": (1.0, 1.0), "4": (1.0, edit.token_set_ratio(" ", " "))}


def test_runs_found_by_pattern(spark, tmp_path):
    for name in ("gate_a+b_lr0.010_ep2.pt", "gate_c_lr0.050_ep10.pt", "notes.txt"):
        (tmp_path / name).write_text("x")
    found = metric_log.found_runs(spark, str(tmp_path))
    assert {(r.model, r.lr, r.epochs) for r in found.collect()} == {("a+b", 0.01, 2), ("c", 0.05, 10)}
    runs = spark.createDataFrame([(1, "a+b", 0.01, 2), (2, "a+b", 0.01, 3)], "run_id int, model string, lr double, epochs int")
    assert [r.run_id for r in metric_log.without_file(runs, found).collect()] == [2]
    assert metric_log.found_runs(spark, str(tmp_path / "none")).count() == 0
