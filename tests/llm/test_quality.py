import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paircraft.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    covered = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 50, "one two\n\none two\n  \none two",
         " ".join(map(str, range(5000))), "é ñ 🙂 # $ <| \x0b\x0c\r\n" * 3, "a b c d e f " + " ".join(map(str, range(90))) + " a b c d e f",
         "    z"]


def test_measures_edges(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = sorted(tuple(r) for r in quality.judge(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect())
    assert [g[:7] for g in got] == sorted((i, *brute(t)) for i, t, _ in rows)
    assert all(g[7] == (not g[6]) for g in got)
    assert quality.judge(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 0


def test_table_and_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert {d: tuple(r)[1:7] for d, r in got.items()} == {d: brute(t) for d, t in texts.items()}
    assert all(not (r.base_failed and r.kept) for r in got.values())
    good = [got[r.doc_id].kept for r in labels.where("quality = 1").collect()]
    bad = [got[r.doc_id].kept for r in labels.where("quality = 0").collect()]
    assert sum(good) / len(good) > 0.9
    assert sum(bad) / len(bad) < sum(good) / len(good)


def test_learner_finds_planted_rule(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        m = {k: rnd.random() for k in quality.MEASURES}
        rows.append((i, int(m["upper_share"] > 0.8 and m["n_words"] <= 0.5), m))
    fields = ", ".join(f"{k}: double" for k in quality.MEASURES)
    df = spark.createDataFrame(rows, f"key bigint, bad int, m struct<{fields}>")
    rules = quality.learn(df)
    assert rules
    wrong = df.where(quality.verdict(rules) == (F.col("bad") == 1)).count()
    assert wrong < 90
    used = {c.measure for r in rules for c in r.conditions}
    assert {"upper_share", "n_words"} <= used
