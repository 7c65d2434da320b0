import random

import pytest

from paircraft.llm import jaccard_join, minhash
from paircraft.llm.components import components


def sets_of(rows):
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.append((d, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows, percent=75):
    sets = sets_of(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    index = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * len(s | sets[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def family(rnd, n, start):
    """Near copies of one text at many distances, chains among them."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(50)}"
        t = t[:len(t) - rnd.randrange(12)]
        rows.append((start + i, " ".join(t)))
        if rnd.random() < 0.2:
            base = t + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(8))]
    return rows


def corpus(seed=5):
    rnd = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one two"), (5, "One TWO three"), (6, "a b c d e"),
            (7, "a b c d e f"), (8, "word " * 3000), (9, "word " * 7)]
    for k in range(12):
        rows += family(rnd, rnd.randrange(2, 40), 1000 * (k + 1))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("region", [4096, 8])
def test_components_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, n int, keys string").repartition(3)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def one_family(rnd, n):
    """Distinct near copies of one text, some near to others only, and texts that share a passage with them."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        t = list(base)
        for k in rnd.sample(range(56, 60), rnd.randrange(1, 3)):
            t[k] = f"x{i}"
        if i % 7 == 0:
            t = t[:52] + [f"y{i % 35} {j}" for j in range(rnd.randrange(12))]
        if i % 50 == 0:
            t = t[:30] + [f"z{i % 150} {j}" for j in range(30)] + [f"u{i}"]
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("pivots", "n"), [(2, 600), (16, 600)])
def test_family_of_near_copies_is_dealt_out(spark, monkeypatch, pivots, n):
    monkeypatch.setattr(jaccard_join, "REGION", 64)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    seen, join = [], jaccard_join.join_regions

    def watched(members, percent):
        seen.extend((r["region"], r["count"]) for r in members.groupBy("region").count().collect())
        return join(members, percent)
    monkeypatch.setattr(jaccard_join, "join_regions", watched)
    rows = one_family(random.Random(3), n)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    # a block and a slice of about 64 rows each, no copy of the family
    assert max(c for _, c in seen) < 3 * 64 and sum(c for _, c in seen) < 8 * n


def chained(rnd, n):
    """Texts of 6 passages out of 60: chained, but no two link, but for a few copies with a small edit."""
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(60)]
    rows = []
    for i in range(n):
        t = [w for k in rnd.sample(range(60), 6) for w in passages[k]]
        rows.append((i, " ".join(t)))
        if i % 20 == 0:
            rows += [(1000 + i, " ".join(t[:-8])), (2000 + i, " ".join([*t, *[f"z{j}" for j in range(i % 40)]]))]
    return rows


@pytest.mark.parametrize("shingles", [1 << 22, 2000])
def test_island_that_no_pivot_covers(spark, monkeypatch, shingles):
    monkeypatch.setattr(jaccard_join, "REGION", 32)
    monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", shingles)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 8)
    banded, bands = [], jaccard_join.in_bands
    monkeypatch.setattr(jaccard_join, "in_bands", lambda m, percent: banded.append(m.count()) or bands(m, percent))
    rows = chained(random.Random(1), 240)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert len(banded) == 1 and banded[0] > 100  # one pass ends it


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 1, 2)]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect()) == brute(rows)


def test_minhash_classes(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == [(d, c) for d, _, c in brute(rows)]


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [
        (2000 + rnd.randrange(300), 2000 + rnd.randrange(300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
