import numpy as np
import pandas as pd

from paircraft.plans.ordered import average_ranks, exact_quantiles, next_in_group, ordered_cumsum


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(size=500), 1)  # many ties
    grp = rng.integers(0, 3, size=500)
    df = spark.createDataFrame(pd.DataFrame({"g": grp, "x": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q_idx): r.value for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    for g in range(3):
        ref = np.percentile(vals[grp == g], [p * 100 for p in probs])
        for i, v in enumerate(ref):
            assert abs(got[(g, i)] - v) < 1e-9
    glob = {r.q_idx: r.value for r in exact_quantiles(df, "x", probs).collect()}
    for i, v in enumerate(np.percentile(vals, [p * 100 for p in probs])):
        assert abs(glob[i] - v) < 1e-9


def test_average_ranks_match_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r._x: r.rank for r in average_ranks(df, "x").collect()}
    ref = pd.Series(vals).rank(method="average")
    for v, r in zip(vals, ref):
        assert got[v] == r


def test_next_in_group_same_for_1_and_8_partitions(spark):
    rows = [(g, i) for g in ("a", "b", None) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "g string, id long")
    a = sorted((tuple(r) for r in next_in_group(df, ["g"], "id", "nxt", partitions=1).collect()), key=repr)
    b = sorted((tuple(r) for r in next_in_group(df, ["g"], "id", "nxt", partitions=8).collect()), key=repr)
    assert a == b
    pdf = pd.DataFrame(rows, columns=["g", "id"]).fillna("~")
    pdf["nxt"] = pdf.sort_values("id").groupby("g")["id"].shift(-1)
    ref = sorted(((None if g == "~" else g, i, None if pd.isna(n) else int(n)) for g, i, n in pdf.itertuples(index=False)), key=repr)
    assert a == ref


def test_ordered_cumsum(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "x double, c int")
    got = sorted((r.x, r.cum_c) for r in ordered_cumsum(df, "x", ["c"], partitions=7).collect())
    assert [c for _, c in got] == list(range(1, 101))
