import random

import numpy as np

from paircraft.operators import experts, knn
from paircraft.sources import metric_log


def test_parse_log_glued_and_commas(spark):
    text = ("2025-06-04 01:54:53,nb.py,pid=1,eda=x,value=a,b"
            "2025-06-04 01:54:54,nb.py,pid=2,model=m\n")
    df = spark.createDataFrame([(text,), ("2025-06-04 01:54:55,nb.py",)], "value string")
    rows = metric_log.parse_log(df).orderBy("ts").collect()
    assert len(rows) == 3
    assert rows[0].attrs["value"] == "a,b"
    assert rows[1].model == "m"
    assert rows[2].caller == "nb.py" and rows[2].pid is None


def _lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def test_bit_parallel_lcs_matches_dp():
    rnd = random.Random(3)
    for _ in range(300):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 30)))
        b = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 30)))
        assert experts.lcs_length(a, b) == _lcs_dp(a, b)
    assert experts.indel_ratio("", "") == 1.0
    assert experts.token_set_ratio("a b", "a b c") == 1.0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 4))
    X[1] = X[0]  # a duplicate point: distance 0
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<double>")
    got = {}
    for r in knn.knn_join(df, df, k=3, blocks=3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    for i in range(60):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        ref = [int(j) for j in np.lexsort((np.arange(60), np.round(d, 9)))[:3]]
        assert [n for _, n in sorted(got[i])] == ref


def test_append_and_follow_log(spark, tmp_path):
    from paircraft.streaming.log_follow import follow_log
    root = str(tmp_path / "log")
    ev = spark.createDataFrame([("2025-06-04 01:00:00", "t.py", 7, "m1", 1.5)],
                               "ts string, caller string, pid int, model string, seconds double")
    metric_log.append_events(ev, root, "benchmarks", "lr0.01_ep2")
    out = str(tmp_path / "parsed")
    follow_log(spark, root, out, str(tmp_path / "ck"))
    metric_log.append_events(ev.withColumn("model", ev.model.substr(1, 1)), root, "benchmarks", "lr0.01_ep2")
    follow_log(spark, root, out, str(tmp_path / "ck"))  # only the new file is parsed
    rows = spark.read.parquet(out).collect()
    assert sorted(r.model for r in rows) == ["m", "m1"]


def test_porter_published_examples():
    from paircraft.operators.stemming import porter_stem
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file",
             "happy": "happi", "relational": "relat", "conditional": "condit", "generalization": "gener",
             "electrical": "electr", "adjustment": "adjust", "controll": "control", "roll": "roll"}
    for w, s in cases.items():
        assert porter_stem(w) == s, (w, porter_stem(w), s)


def test_stem_job_keeps_order(spark):
    from paircraft.operators.stemming import stem_column
    df = spark.createDataFrame([(1, ["cats", "running", "cats"]), (2, [])], "k long, t array<string>")
    got = {r.k: r.clean for r in stem_column(df, "k", "t").collect()}
    assert got[1] == "cat run cat" and got[2] == ""
