import zlib
from hashlib import sha256

import pytest

from paircraft.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def digest(s):
    return sha256(s.encode()).hexdigest()


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            out.append((level[i ^ 1], i & 1) if i ^ 1 < len(level) else None)
            i >>= 1
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[k] = levels([leaf(r, r[4]) for r in groups[k]])
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            way = siblings(trees[k], i) + siblings(top, g)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf(r, r[4] + bad if r[4] is not None else None)
            for s in way:
                x = digest(x) if s is None else digest(s[0] + x if s[1] else x + s[0])
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], digest("".join(s[0] for s in way if s)), x, x == top[-1][0]))
    return sorted(out, key=repr)


def docs(n, langs):
    return [(i, f"text é {i}" * (i % 5), langs[i * i % len(langs)], f"s{i % 3}", i, "x", 1) for i in range(n)]


@pytest.mark.parametrize("height", [10, 2, 1])
@pytest.mark.parametrize("langs", [["en"], ["en", None, "de", "", "fr"]])
def test_equal_to_brute_force(spark, height, langs, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 1 << height)
    rows = docs(37, langs)
    rows += [rows[3], rows[3], (3, None, "en", None, None, "x", 1), (None, "t", None, "s", 5, "x", 1), (40, "x" * 100_000, "en", "s", 9223372036854775807, "x", 1)]
    got = sorted((tuple(r) for r in merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)
    assert got == brute(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame(docs(1, ["en"]), SCHEMA)
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof == []
    assert merkle.report(one.limit(0)).count() == 0


def test_versions_copy_ancestors_only(spark):
    rows = docs(21, ["en", "de"])
    got = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, r in got.items():
        assert (r.version is not None) == (zlib.crc32(str(i).encode()) % 7 == 0)
        if r.version:
            assert r.version[-1] == r.folded_root != r.root and r.version[0] != r.leaf and len(r.version) <= 7
    tree = merkle.PathCopyTree([digest(str(i)) for i in range(8)], False)
    before = [list(level) for level in tree.levels]
    others, lefts = tree.siblings(5)
    path = merkle.copied_path(digest("new"), others, lefts)
    assert len(path) == 4 and tree.levels == before  # all other nodes are shared, none is changed
    changed = merkle.PathCopyTree([digest("new") if i == 5 else digest(str(i)) for i in range(8)], False)
    assert path == [changed.levels[k][5 >> k] for k in range(4)]


def test_leaf_digest_by_hand(spark):
    row = (7, "aé", None, "s", 2, "x", 1)
    assert merkle.report(spark.createDataFrame([row], SCHEMA)).first().leaf == digest("1:7" + "1:s" + "-" + "1:2" + "3:aé")
