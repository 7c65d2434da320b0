import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from paircraft.llm import line_dedup

SPACE = line_dedup.SPACE


def brute(rows, min_sites=line_dedup.MIN_SITES):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(SPACE)].add(s)
    bare = lambda x: len("".join(c for c in x if c not in SPACE))
    out = []
    for d, t, _ in rows:
        parts = [] if t is None else t.split("\n")
        bad = [x.strip(SPACE) != "" and len(sites[x.strip(SPACE)]) >= min_sites for x in parts]
        rest = "\n".join(x for x, b in zip(parts, bad, strict=True) if not b)
        kept = (t or "") if any(bad) and 2 * bare(rest) < bare(t) else rest
        out.append((d, len(parts), sum(bad), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows():
    rnd = random.Random(1)
    common = [f"common line {i}" for i in range(30)]
    out = []
    for d in range(400):
        body = [f"own {d} {i} é" * 3 for i in range(rnd.randrange(6))]
        body += rnd.sample(common, rnd.randrange(3)) + [""] * rnd.randrange(2) + ["  " + common[0] + "\t"]
        rnd.shuffle(body)
        out.append((d, "\n".join(body), f"s{int(rnd.expovariate(0.15)) if d % 3 else 0}"))
    return out + [(900, None, "s1"), (901, "", None), (902, "common line 0", None), (903, "\n" * 5000, "s2"), (5, *out[5][1:])]


def test_against_brute_force(spark):
    r = rows()
    docs = spark.createDataFrame([(*x, 1, 2) for x in r], "doc_id bigint, text string, source string, pos int, key int").repartition(5)
    got = line_dedup.report(docs, F.col("source"))
    assert sorted(tuple(x) for x in got.collect()) == brute(r)
    clean = line_dedup.dedup(docs, F.col("source"))
    assert clean.columns == docs.columns and clean.count() == len(r)
    assert line_dedup.report(docs.limit(0), F.col("source")).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    r = [(i, f"line {k}\n" + f"text {i} {k} " * 9, f"site{i}") for k in range(60, 70) for i in range(k)]
    docs = spark.createDataFrame(r, "doc_id bigint, text string, source string")
    got = line_dedup.report(docs, F.col("source"), min_sites=64).collect()
    assert sorted(tuple(x) for x in got) == brute(r, 64)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(x) for x in line_dedup.report(docs, F.col("source")).collect())
    assert got == brute([(x.doc_id, x.text, x.source) for x in docs.collect()])
    assert any(x[2] for x in got)
