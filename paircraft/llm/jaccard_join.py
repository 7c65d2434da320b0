"""Exact n-gram Jaccard self-join in metric space.

Documents are sets of 5-word shingles; Jaccard distance d = 1 - J is a metric,
and two documents link when d <= r (J >= ``threshold``). The join finds the
components of the links without any list of all pairs:

1. Shingles are counted over the whole corpus: each block of documents sends
   one packed row per hash range, and the range's task finds the shingles that
   two documents or more hold. A link needs a common part of at least
   ``threshold`` of either set, so a document with fewer shared shingles links
   with nothing and is done.
2. The others are at distance 1 from most pivots that one could choose, so
   they are first parted into islands: a pair that links shares one of the
   rarest shingles of each (of n shingles in one order for all, the first
   n - ceil(threshold n) + 1), so documents that no chain of such shingles
   connects are farther apart than r.
3. In a large island, pivots contract what is near them: documents within r
   of a pivot are linked to it, and pivots that share such a document are one
   class. By the triangle inequality, a document that links with a class is
   within 2 r of one of its pivots; only such documents (of a smaller class or
   of none) ask, in blocks, salted slices of the linked ones. Documents that
   no pivot reached are parted into islands again, with new pivots, until no
   island exceeds the bound.
4. A region's task joins it exactly: documents outside its largest component
   are compared with all others; those inside it are connected already.
5. Where pivots take out too few (documents that a common passage chains but
   that lie in no pivot's radius), what is left is windowed by the distance to
   the empty set, the size: documents that link differ by no more than the
   threshold in size, so a band of sizes meets itself and the next one, in
   salted blocks of bounded size. This ends after one pass whatever the data.

Empty and null texts link with nothing. Equal sets are one node from the
start. Repeated rows are kept; a null id never becomes a component's id while
another member has one. An empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import WordCodes, cut, n_parts, shingles, slices, words
from paircraft.llm.components import components

PERCENT = 75
#: Documents and shingles of a block, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1 << 21
#: Documents of a region, a block or a slice that one task joins, about; pivots of a round: documents for
#: each, at least, at most.
REGION, PER_PIVOT, PIVOTS, MAX_PIVOTS = 4096, 64, 16, 256
#: Shingles of a region, a block or a slice, about; share of the members that a round of pivots has to take out.
REGION_SHINGLES, PROGRESS = 1 << 22, 0.125


def packed(docs: DataFrame, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, shard, counts, hashes) with a block's distinct sets cut by
    hash range, and one row per block (shard -1) that tells its members."""
    schema = ("block bigint, shard int, counts binary, hashes binary, ids array<bigint>, places array<int>, "
              "sizes array<int>, keys array<bigint>")
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block = WordCodes(), TaskContext.get().partitionId() << 20
        members: list[tuple] = []
        place: dict[int, int] = {}
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, places, sizes, keys = (list(c) for c in zip(*members, strict=True))
            rows = [(block, -1, None, None, ids, places, sizes, keys)]
            if sets:
                flat = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                shard = ((flat >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                low, doc, ends = flat[order].astype("<u4"), doc[order], np.searchsorted(shard[order], np.arange(ranges + 1))
                for s in np.flatnonzero(np.diff(ends)).tolist():
                    part = slice(ends[s], ends[s + 1])
                    counts = np.bincount(doc[part], minlength=len(sets)).astype("<u4")
                    rows.append((block, s, counts.tobytes(), low[part].tobytes(), None, None, None, None))
            members.clear()
            place.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.unique(shingles(codes.of(words(text))))
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if len(s) and key not in place:
                    place[key] = len(sets)
                    sets.append(s)
                    held += len(s)
                members.append((doc, place.get(key, -1), len(s), key))
                if len(members) >= BLOCK_DOCS or held >= BLOCK_SHINGLES:
                    yield flush()
                    block, held = block + 1, 0
        if members:
            yield flush()

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, schema)


def shared_shingles(rows: DataFrame, ranges: int) -> DataFrame:
    """(node, key) of the shingles that two nodes or more hold; a range's task
    sorts the hashes that the blocks sent it. A key begins with the number of
    its nodes (1,023 at most), so keys in order are the rarest first, in one
    order for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, nodes, shards = [], [], []
        for b in batches:
            for block, shard, counts, low in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                counts = np.frombuffer(counts, "<u4")
                hashes.append(np.frombuffer(low, "<u4"))
                nodes.append(np.repeat((block << 16) + np.arange(len(counts), dtype=np.int64), counts))
                shards.append(np.full(len(hashes[-1]), shard, np.int64))
        if not hashes:
            return
        key = (np.concatenate(shards) << 32) | np.concatenate(hashes)
        node = np.concatenate(nodes)
        hashes.clear(), nodes.clear(), shards.clear()
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        df = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
        keep = df > 1
        key, node = np.minimum(df[keep], 1023) << 53 | key[keep], node[keep]
        for i in range(0, len(key), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(key[part])], ["node", "key"])

    dealt = rows.where("shard >= 0").select("block", "shard", "counts", "hashes").repartitionById(ranges, F.col("shard"))
    return dealt.mapInArrow(run, "node bigint, key bigint")


class Links:
    """Exact links inside one region of (node, n, keys)."""

    def __init__(self, nodes: list[int], sizes: list[int], keys: list[np.ndarray], percent: int):
        self.nodes, self.n, self.percent = nodes, np.array(sizes, np.int64), percent
        self.root = list(range(len(nodes)))
        flat = np.concatenate(keys)
        doc = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
        _, self.key = np.unique(flat, return_inverse=True)
        self.start = np.r_[0, np.cumsum([len(k) for k in keys])]
        order = np.argsort(self.key, kind="stable")
        self.holders, self.at = doc[order], np.r_[0, np.cumsum(np.bincount(self.key))]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def common(self, i: int) -> np.ndarray:
        """Sizes of the intersections of i with every document."""
        mine = self.key[self.start[i]:self.start[i + 1]]
        return np.bincount(np.concatenate([self.holders[self.at[k]:self.at[k + 1]] for k in mine]),
                           minlength=len(self.nodes))

    def compare(self, i: int, among: np.ndarray | bool = True) -> None:
        both = self.common(i)
        near = np.flatnonzero((100 * both >= self.percent * (self.n + self.n[i] - both)) & among)
        for j in near.tolist():
            a, b = self.find(i), self.find(j)
            self.root[max(a, b)] = min(a, b)

    def run(self) -> list[tuple[int, int]]:
        """Edges (node, its component's first node). A pivot at a time is
        compared with all; when half of the region is one component, only the
        documents outside it are left to compare."""
        todo = list(range(len(self.nodes)))
        while todo:
            i = todo.pop()
            self.compare(i)
            if len(todo) % 16 == 0 or len(todo) > len(self.nodes) - 8:
                roots = [self.find(j) for j in range(len(self.nodes))]
                kinds, sizes = np.unique(roots, return_counts=True)
                if sizes.max() * 2 > len(roots):
                    todo = [j for j in todo if roots[j] != kinds[sizes.argmax()]]
        return self.edges()

    def ask(self, asks: list[bool]) -> list[tuple[int, int]]:
        """Edges between documents that ask and the others; those of one side
        are not compared with each other."""
        told = ~np.array(asks)
        for i in np.flatnonzero(~told).tolist():
            self.compare(i, told)
        return self.edges()

    def edges(self) -> list[tuple[int, int]]:
        return [(self.nodes[i], self.nodes[self.find(i)]) for i in range(len(self.nodes)) if self.find(i) != i]


def join_regions(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of each region of (region, node, n, keys, asks); regions
    are dealt by key and read one after the other from a sorted partition.
    Where ``asks`` is null, all documents of a region are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list) -> pa.RecordBatch:
            links = Links([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], percent)
            edges = links.run() if group[0][3] is None else links.ask([g[3] for g in group])
            a, b = zip(*edges, strict=True) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, group = None, []
        for b in slices(batches):
            keys = b.column(3)
            for i, (region, node, n, asks) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 4)), strict=True)):
                if region != now and group:
                    if len(group) > 1:
                        yield done(group)
                    group = []
                now = region
                group.append((node, n, np.asarray(keys[i].values), asks))
        if len(group) > 1:
            yield done(group)

    dealt = members.select("region", "node", "n", "keys", "asks").repartition(n_parts(members), "region")
    return dealt.sortWithinPartitions("region", "node").mapInArrow(run, "a bigint, b bigint")


def reach(members: DataFrame, percent: int, seed: int) -> DataFrame:
    """(node, n, keys, near, close) of the members (region, node, n, keys,
    count) of large regions: the pivots within r and within 2 r of each. Pivots
    are drawn by hash; a region's members are dealt by salt, about ``REGION``
    of them to a task, and each salt gets the region's pivots."""
    salts = F.ceil(F.col("count") / REGION).cast("int")
    drawn = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("count")) < F.least(
        F.greatest(F.floor(F.col("count") / PER_PIVOT), F.lit(PIVOTS)), F.lit(MAX_PIVOTS))
    given = members.where(drawn).groupBy("region", salts.alias("salts")).agg(
        F.collect_list(F.struct("node", "n", "keys")).alias("pivots"))
    given = given.select(F.col("region").alias("p_region"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("p_salt"), "pivots")
    schema = "node bigint, n int, keys array<bigint>, near array<bigint>, close array<bigint>"
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        piv = right.column("pivots")[0].as_py() if right.num_rows else []
        ids, m = np.array([p["node"] for p in piv], np.int64), np.array([p["n"] for p in piv], np.int64)
        flat = np.array([k for p in piv for k in p["keys"]], np.int64)
        holder = np.repeat(np.arange(len(piv)), [len(p["keys"]) for p in piv])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], holder[order]
        out = []
        keys = left.column("keys").combine_chunks()
        for i, (node, n) in enumerate(zip(left.column("node").to_pylist(), left.column("n").to_pylist(), strict=True)):
            mine = np.asarray(keys[i].values)
            lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            held = [holder[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
            both = np.bincount(np.concatenate(held), minlength=len(piv)) if held else np.zeros(len(piv), np.int64)
            union = m + n - both
            out.append((node, n, mine, ids[100 * both >= percent * union], ids[100 * both >= (2 * percent - 100) * union]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                    [c.split()[0] for c in schema.split(", ")])

    salt = F.pmod(F.xxhash64("node"), salts).cast("int")
    dealt = members.select("region", salt.alias("salt"), "node", "n", "keys").groupBy("region", "salt")
    return dealt.cogroup(given.groupBy("p_region", "p_salt")).applyInArrow(run, schema)


def contract(members: DataFrame, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges, rest) of large regions (region, node, n, keys, count): all links
    of the members that pivots reach, and the members that none reaches."""
    placed = cut(members.transform(reach, percent, seed))
    linked = placed.where(F.size("near") > 0)
    spokes = linked.select("node", F.explode("near").alias("b")).where("node <> b").select(F.col("node").alias("a"), "b")
    pairs = linked.select(F.element_at("near", 1).alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    classes = components(pairs).select(F.col("node").alias("pivot"), "component")
    class_of = lambda df: df.join(classes, "pivot", "left").withColumn("class", F.coalesce("component", "pivot"))
    own = class_of(linked.select("node", F.element_at("near", 1).alias("pivot"))).select("node", "class")
    own = cut(own.join(members.select("node", "region"), "node"))
    size = own.groupBy("class").count()
    # of two classes the smaller one asks; a member of no class asks all that are near enough
    other = class_of(placed.select("node", F.explode("close").alias("pivot"))).select("node", F.col("class").alias("other")).distinct()
    other = other.join(size.select(F.col("class").alias("other"), F.col("count").alias("other_size")), "other")
    mine = own.join(size, "class").select("node", "class", "count")
    asking = other.join(mine, "node", "left").where(
        F.col("class").isNull() | (F.struct("count", "class") < F.struct(F.col("other_size").alias("count"), F.col("other").alias("class"))))
    asking = cut(asking.select("node").distinct().join(members.select("node", "region"), "node"))
    n = own.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / REGION).cast("int").alias("slices")).join(
        asking.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / REGION).cast("int").alias("blocks")), "region")
    dealt = lambda parts, k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    told = own.join(n, "region").select("region", "node", dealt("slices", 1).alias("slice"), each("blocks").alias("block"), F.lit(False).alias("asks"))
    put = asking.join(n, "region").select("region", "node", each("slices").alias("slice"), dealt("blocks", 2).alias("block"), F.lit(True).alias("asks"))
    both = told.unionByName(put).select(F.xxhash64("region", "slice", "block").alias("region"), "node", "asks")
    found = join_regions(both.join(placed.select("node", "n", "keys"), "node"), percent)
    return cut(spokes.unionByName(found)), placed.where(F.size("near") == 0).select("node", "n", "keys")


def with_parts(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, count, parts): members of each group, and the salts that bound their number and shingles."""
    return members.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.greatest(F.ceil(F.count(F.lit(1)) / REGION), F.ceil(F.sum(F.size("keys").cast("bigint")) / REGION_SHINGLES)).cast("int").alias("parts"))


def in_bands(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of members (region, node, n, keys), by bands of their size."""
    # a little wider than the ratio, so that rounding can't put two bands between documents that link
    width = math.log(100 / percent) + 1e-9
    banded = cut(members.withColumn("band", F.floor(F.log("n") / width)))
    parts = cut(with_parts(banded, ["region", "band"]).select("region", "band", "parts"))
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    mine = banded.join(parts, ["region", "band"]).select("region", "band", "node", "parts", salt.alias("salt"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    within = mine.select("region", "band", "node", "salt", F.explode(each).alias("other"))
    within = within.select("region", "band", F.lit(0).alias("step"), F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"),
                           "node", F.when(F.col("salt") != F.col("other"), F.col("salt") > F.col("other")).alias("asks"))
    above = parts.select("region", (F.col("band") - 1).alias("band"), F.col("parts").alias("far"))
    below = parts.select("region", (F.col("band") + 1).alias("band"), F.col("parts").alias("far"))
    far = F.explode(F.sequence(F.lit(0), F.col("far") - 1)).alias("other")
    up = mine.join(above, ["region", "band"]).select("region", "band", F.lit(1).alias("step"), F.col("salt").alias("i"), "node", far, F.lit(True).alias("asks"))
    up = up.withColumnRenamed("other", "j")
    down = mine.join(below, ["region", "band"]).select("region", (F.col("band") - 1).alias("band"), F.lit(1).alias("step"), F.col("salt").alias("j"), "node",
                                                       far, F.lit(False).alias("asks")).withColumnRenamed("other", "i")
    both = within.unionByName(up).unionByName(down)
    both = both.select(F.xxhash64("region", "band", "step", "i", "j").alias("region"), "node", "asks")
    return join_regions(both.join(banded.select("node", "n", "keys"), "node"), percent)


def islands_of(keys: DataFrame) -> DataFrame:
    """(node, region) of the nodes that a chain of ``keys`` (key, node) connects."""
    least = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    chains = keys.join(least.select("key", "lo"), "key").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    return components(chains).withColumnRenamed("component", "region")


def link(nodes: DataFrame, keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the nodes (node, n, keys array) that link; ``keys``
    (key, node): pairs that link share a key. Every round takes its pivots and
    all within r of them out of the large regions; a round that takes out less
    than ``PROGRESS`` of their members is the last one."""
    members = cut(nodes.join(islands_of(keys), "node").select("region", "node", "n", "keys"))
    edges, seed = None, 0
    while True:
        sizes = cut(with_parts(members, ["region"]).where("parts > 1").select("region", "count"))
        before = sizes.agg(F.sum("count")).first()[0]
        if not before:
            break
        near, rest = contract(cut(members.join(sizes, "region")), percent, seed)
        if rest.count() > (1 - PROGRESS) * before:
            left = rest.join(members.select("node", "region"), "node").select("region", "node", "n", "keys")
            near = cut(near.unionByName(in_bands(left, percent)))
            members = cut(members.join(sizes, "region", "left_anti"))
            edges = near if edges is None else edges.unionByName(near)
            break
        parted = rest.join(islands_of(keys.join(rest.select("node"), "node", "left_semi")), "node")
        members = cut(members.join(sizes, "region", "left_anti").unionByName(parted.select("region", "node", "n", "keys")))
        edges = near if edges is None else edges.unionByName(near)
        seed += 1
    joined = join_regions(members.withColumn("asks", F.lit(None).cast("boolean")), percent)
    return components(joined if edges is None else joined.unionByName(edges))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    ranges = min(2 * n_parts(docs), 1 << 20)
    rows = cut(packed(docs, ranges, id_col, text_col))
    told = rows.where("shard < 0").select("block", F.explode(F.arrays_zip("ids", "places", "sizes", "keys")).alias("m"))
    members = told.select(F.col("m.ids").alias("id"), F.col("m.sizes").alias("n"), F.col("m.keys").alias("set"),
                          F.when(F.col("m.places") >= 0, F.col("block") * 65536 + F.col("m.places")).alias("node"))
    # one node stands for all with the same set, found on narrow rows
    one = (members.where("node is not null").groupBy("set").agg(F.min(F.struct("node", "n")).alias("f"))
           .select("set", "f.node", "f.n"))
    shared = shared_shingles(rows, ranges).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("s"))
    able = shared.join(one, "node").where(F.size("s").cast("bigint") * 100 >= F.col("n") * percent)
    able = cut(able.select("set", "n", "s"))
    # shingles of no other document come first in the order and are no keys
    first = F.size("s") - F.expr(f"(n * {percent} + 99) div 100") + 1
    keys = able.select(F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("key"),
                       F.col("set").alias("node"))
    nodes = able.select(F.col("set").alias("node"), "n", F.col("s").alias("keys"))
    found = link(nodes, keys, percent)
    named = members.join(found.withColumnRenamed("node", "linked"), F.col("set") == F.col("linked"), "left")
    named = named.select("id", "n", F.coalesce("component", "set").alias("class"))
    first_id = named.where("n > 0").groupBy("class").agg(F.min("id").alias("first_id"))
    full = named.where("n > 0").join(first_id, "class").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.col("first_id").alias("component_id"))
    empty = named.where("n = 0").select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_shingles"),
                                        F.col("id").alias("component_id"))
    return full.unionByName(empty)
