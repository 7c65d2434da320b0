"""Merkle manifest of a table, with a version of the tree for every tampered row.

Each row is a leaf: the digest of its canonical text (``leaf_digest``). The
leaves of a group stand in the order of their ids; every two consecutive nodes
become their digest (a last one alone too) until the group's root remains; the
groups' roots, in the order of the groups, likewise give the root of all.

The tree is persistent. ``PathCopyTree`` holds an aligned block of at most
``BLOCK`` nodes and its levels; a version with one node replaced copies that
node's ancestors only and shares all others. Blocks are built where their rows
are; a block's top is a row of the next table, which is parted into aligned
blocks again, until a group has one block. On the way down every block hands
the upper siblings of its rows to the blocks below, where each version goes on
through them to its root; no table of all nodes is ever in one place.

Null fields count as ``-``; a null id stands first and is not tampered with,
a null group comes first. Repeated rows are leaves of their own, next to each
other; rows of one id stand in the order of their digests. An empty table
gives no rows. Other columns are ignored. A lone leaf is its group's root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paircraft.llm.common import cut, n_parts, slices, word_crc

#: Levels and nodes of an aligned block.
HEIGHT = 10
BLOCK = 1 << HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the values: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in text]).cast("binary"), 256)


def node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class PathCopyTree:
    """Levels of an aligned block, from its leaves up. ``whole``: the tree goes
    on above the block, so that even a node alone climbs all ``height`` levels."""

    def __init__(self, leaves: list[str], whole: bool, height: int = HEIGHT):
        self.levels = [leaves]
        while len(self.levels) <= height if whole else len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([node(low[i:i + 2]) for i in range(0, len(low), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> tuple[list[str | None], list[bool]]:
        """The other node of each run on the way up (None: alone), and whether it is on the left."""
        others, lefts = [], []
        for level in self.levels[:-1]:
            j = i ^ 1
            others.append(level[j] if j < len(level) else None)
            lefts.append(j < i)
            i >>= 1
        return others, lefts


def copied_path(leaf: str, others: list[str | None], lefts: list[bool]) -> list[str]:
    """The nodes that a version with this leaf copies, from the leaf to the
    root; all others it shares."""
    path = [leaf]
    for other, left in zip(others, lefts, strict=True):
        run = [path[-1]] if other is None else [other, path[-1]] if left else [path[-1], other]
        path.append(node(run))
    return path


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (place in its key, from 0) and ``n`` (rows of the
    key), by ranges of (key, order): no key's rows meet in one task."""
    by = [F.col(c).asc_nulls_first() for c in order]
    part = cut(rows.repartitionByRange(n_parts(rows), F.col(key), *by).withColumn("_part", F.spark_partition_id()))
    local = part.withColumn("_row", F.row_number().over(Window.partitionBy("_part", key).orderBy(*by)))
    # a row for each key that a range holds
    sizes = part.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_size"))
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", key, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
                         F.sum("_size").over(of_key).alias("n"))
    return cut(local.join(sizes, ["_part", key]).select(*rows.columns, (F.col("_before") + F.col("_row") - 1).alias("at"), "n"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows (key, block, at, ...) dealt by aligned block, each block's rows in order."""
    return rows.repartition(n_parts(rows), "key", "block").sortWithinPartitions("key", "block", "at")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block at a time."""
    now, group = None, []
    for b in slices(batches):
        for row in b.to_pylist():
            if (row["key"], row["block"]) != now:
                if group:
                    yield group
                now, group = (row["key"], row["block"]), []
            group.append(row)
    if group:
        yield group


def tops(rows: DataFrame) -> DataFrame:
    """(key, at, n, digest) of the blocks of (key, at, n, digest): the next table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            n = group[0]["n"]
            tree = PathCopyTree([r["digest"] for r in group], n > BLOCK, HEIGHT)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([group[0]["key"]], pa.string()), "at": pa.array([group[0]["block"]], pa.int64()),
                "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([tree.top], pa.string())})

    dealt = blocks_of(rows.select("key", F.expr(f"at div {BLOCK}").alias("block"), "at", "n", "digest"))
    return cut(dealt.mapInArrow(run, "key string, at bigint, n bigint, digest string"))


UPPER = "others array<string>, lefts array<boolean>, subroot string, root string"


def _with_upper(rows: DataFrame, upper: DataFrame, extra: list[str]) -> DataFrame:
    """The rows of each block after the row of ``upper`` (key, at, ...) for it."""
    own = rows.select("key", F.expr(f"at div {BLOCK}").alias("block"), "at", "n", "digest", *extra)
    given = upper.select("key", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), "others", "lefts", "subroot", "root")
    return blocks_of(own.unionByName(given, allowMissingColumns=True))


def paths(rows: DataFrame, upper: DataFrame) -> DataFrame:
    """(key, at, others, lefts, subroot, root): the siblings of each row up to the root of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *group in grouped(batches):
            tree = PathCopyTree([r["digest"] for r in group], group[0]["n"] > BLOCK, HEIGHT)
            ways = [tree.siblings(i) for i in range(len(group))]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([head["key"]] * len(group), pa.string()), "at": pa.array([r["at"] for r in group], pa.int64()),
                "others": pa.array([o + head["others"] for o, _ in ways], pa.list_(pa.string())),
                "lefts": pa.array([s + head["lefts"] for _, s in ways], pa.list_(pa.bool_())),
                "subroot": pa.array([head["subroot"]] * len(group), pa.string()),
                "root": pa.array([head["root"]] * len(group), pa.string())})

    return cut(_with_upper(rows, upper, []).mapInArrow(run, f"key string, at bigint, {UPPER}"))


def climb(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables from the leaves up, and (key, digest) of the keys' roots."""
    tables, roots = [], None
    while True:
        tables.append(rows)
        above = tops(rows)
        ended = above.where("n = 1").select("key", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        rows = above.where("n > 1")
        if rows.isEmpty():
            return tables, roots


def descend(tables: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``paths`` to the rows above the lowest table: what its blocks are given.
    ``ends``: the way from each key's root on."""
    upper = ends
    for rows in tables[:0:-1]:
        # keys that end at a lower table wait for it
        given = upper.join(rows.select("key", F.expr(f"at div {BLOCK}").alias("at")).distinct(), ["key", "at"], "left_semi")
        rest = ends.join(rows.select("key").distinct(), "key", "left_anti")
        upper = paths(rows, given).unionByName(rest)
    return upper


def versions(leaves: DataFrame, upper: DataFrame) -> DataFrame:
    """The manifest's rows, a version of the tree for each leaf with ``altered``."""
    schema = ("doc_id bigint, leaf string, subroot string, root string, proof array<string>, version array<string>, "
              "folded_root string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *group in grouped(batches):
            tree = PathCopyTree([r["digest"] for r in group], group[0]["n"] > BLOCK, HEIGHT)
            proofs, changed, folded = [], [], []
            for i, r in enumerate(group):
                others, lefts = tree.siblings(i)
                others, lefts = others + head["others"], lefts + head["lefts"]
                path = copied_path(r["altered"] or r["digest"], others, lefts)
                proofs.append([o for o in others if o is not None])
                changed.append(path if r["altered"] else None)
                folded.append(path[-1])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r["doc_id"] for r in group], pa.int64()),
                "leaf": pa.array([r["digest"] for r in group], pa.string()),
                "subroot": pa.array([head["subroot"]] * len(group), pa.string()),
                "root": pa.array([head["root"]] * len(group), pa.string()),
                "proof": pa.array(proofs, pa.list_(pa.string())), "version": pa.array(changed, pa.list_(pa.string())),
                "folded_root": pa.array(folded, pa.string())})

    return _with_upper(leaves, upper, ["doc_id", "altered"]).mapInArrow(run, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "lang",
             counted: str = "n_chars", tampered: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, subroot, root, proof (siblings
    up to the root, from the leaf on), version (where tampered, else null: the
    nodes that its tree copies, from the altered leaf to that tree's root),
    folded_root and verified. Where ``tampered`` holds (as a rule: 7 divides
    the id's crc32), 1 is added to ``counted``."""
    tampered = word_crc(id_col) % 7 == 0 if tampered is None else tampered
    plain = [F.col(c) for c in fields]
    more = (F.col(counted).cast("decimal(38,0)") + 1).cast("string")
    changed = [more if c == counted else F.col(c) for c in fields]
    # no group sorts first, then the groups bytewise
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = cut(docs.select(key.alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), leaf_digest(plain).alias("digest"),
                             F.when(tampered, leaf_digest(changed)).alias("altered"),
                             F.monotonically_increasing_id().alias("row")))
    leaves = numbered(leaves, "key", ["doc_id", "digest", "row"])
    tables, subroots = climb(leaves)
    subroots = cut(subroots)
    groups = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "key", ["group"])
    group_tables, root = climb(groups)
    nothing = [F.array().cast("array<string>").alias("others"), F.array().cast("array<boolean>").alias("lefts")]
    end = root.select("key", F.lit(0).cast("bigint").alias("at"), *nothing, F.lit(None).cast("string").alias("subroot"),
                      F.col("digest").alias("root"))
    ways = paths(groups, descend(group_tables, end)).drop("key", "subroot")
    ends = groups.select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "at").join(ways, "at")
    ends = cut(ends.select("key", F.lit(0).cast("bigint").alias("at"), "others", "lefts", "subroot", "root"))
    told = versions(leaves, descend(tables, ends))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame) -> DataFrame:
    """The manifest with each proof as one digest."""
    return manifest(docs).select("doc_id", "leaf", "subroot", "root",
                                 F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
                                 "folded_root", "verified")


def oracle() -> str:
    """``report`` as DuckDB SQL: level by level, in recursive tables."""
    field = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(field.format(n if c == "n_chars" else c) for c in FIELDS) + ")"
    # the reflected polynomial 0xEDB88320, a byte pos a time, bit by bit
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [CAST(k AS UBIGINT) FOR k IN range(8)]), lambda c, k: {bit})"
    codes = "[CAST(ascii(ch) AS UBIGINT) FOR ch IN string_split(CAST(doc_id AS VARCHAR), '')]"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda a, b: {byte}), 4294967295)"

    def tree(name: str, source: str) -> str:
        """The nodes (g, lvl, pos, n, h) of the trees over ``source`` (g, pos, n, h)."""
        return f"""{name} AS (SELECT g, 0 AS lvl, pos, n, h FROM {source}
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2)"""

    def way(name: str, rows: str, nodes: str) -> str:
        """Siblings of each row (g, pos, id) of ``rows``, in order: (id, sibs); null: alone."""
        return f"""{name} AS (SELECT r.id, list({{'h': s.h, 'left': (r.pos >> u.lvl) & 1 = 1}} ORDER BY u.lvl) AS sibs
  FROM {rows} r JOIN (SELECT DISTINCT g, lvl FROM {nodes} WHERE n > 1) u ON u.g IS NOT DISTINCT FROM r.g
  LEFT JOIN {nodes} s ON s.g IS NOT DISTINCT FROM r.g AND s.lvl = u.lvl AND s.pos = xor(r.pos >> u.lvl, 1) GROUP BY r.id)"""

    fold = ("list_reduce(list_prepend({{'h': {0}, 'left': false}}, {1}), lambda x, s: {{'h': sha256(CASE WHEN s.h IS NULL THEN x.h "
            "WHEN s.left THEN s.h || x.h ELSE x.h || s.h END), 'left': false}}).h")
    return f"""WITH RECURSIVE
_d AS (SELECT doc_id, lang AS g, {leaf('n_chars')} AS h, {leaf('(CAST(n_chars AS HUGEINT) + 1)')} AS changed,
  coalesce({crc} % 7 = 0, false) AS tampered FROM documents),
_l AS (SELECT *, row_number() OVER (ORDER BY g NULLS FIRST, doc_id NULLS FIRST, h) AS id,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM _d),
{tree('_n', '_l')},
_s AS (SELECT g AS lang, h, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n,
  row_number() OVER (ORDER BY g NULLS FIRST) AS id FROM _n WHERE n = 1),
{tree('_m', '_s')},
{way('_w', '_l', '_n')},
{way('_v', '_s', '_m')},
_p AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM _m WHERE n = 1) AS root,
  list_concat(coalesce(w.sibs, []), coalesce(v.sibs, [])) AS sibs, CASE WHEN tampered THEN changed ELSE l.h END AS start
  FROM _l l JOIN _s s ON s.lang IS NOT DISTINCT FROM l.g LEFT JOIN _w w ON w.id = l.id LEFT JOIN _v v ON v.id = s.id),
_f AS (SELECT *, {fold.format('start', 'sibs')} AS folded_root FROM _p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.h FOR s IN sibs IF s.h IS NOT NULL], '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM _f"""
