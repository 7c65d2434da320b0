"""Hard negatives by exact integer inner products, tile by tile.

Vectors become rows of integers (each component times ``SCALE``, rounded
down). Anchors and candidates are dealt into groups by hash; a task meets one
group of anchors with one group of candidates, so that no row of the result is
ever made for a pair of vectors. A tile of their inner products comes from
Strassen's recursion on int64 matrices padded with zeros (seven products of
half the size, sums and differences in exact integers).

Two rounds of tiles, each pair of vectors computed in one of them:

1. tiles of equal labels feed, for each anchor, a heap of its best positives;
2. tiles of different labels feed, for each anchor and positive, a heap of
   the best negatives inside the positive's window.

Heaps are flat arrays (slot, score, id) that hold the best ``k`` of each slot,
higher scores first, ties by smaller id. The worst member of a full heap is a
bar for later tiles. Two heaps merge by joining their arrays and keeping the
best; groups' heaps merge in a tree of ``FAN`` heaps at a time.

Null labels, null vectors, vectors with a null or non-finite component and
rows without an id take no part. An id is one row: where an id repeats, its
smallest (label, vector) stands. Shorter vectors count as padded with zeros,
an empty one as zeros. Anchors without a positive, and positives without a
negative in the window, give no rows; neither does an empty table. Scores are
exact; vectors so large that 100 times a score might exceed 64 bits raise
ArithmeticError. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a group of anchors and of a group of candidates, at most about.
ANCHOR_ROWS, CANDIDATE_ROWS = 4096, 16384
#: Columns of a tile; sides up to which a product is made directly; heaps merged at once.
TILE, DIRECT, FAN = 2048, 8, 32

Heap = tuple[np.ndarray, np.ndarray, np.ndarray]


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices; exact, as long as the result fits 64 bits
    (sums that wrap on the way come back)."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= DIRECT:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    c = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = c[:m, :n], c[:m, n:], c[m:, :n], c[m:, n:]
    p = strassen(a11 + a22, b11 + b22)
    c11[:] = p
    c22[:] = p
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return c


def empty_heap() -> Heap:
    return tuple(np.empty(0, np.int64) for _ in range(3))


def merged(heaps: list[Heap], k: int) -> Heap:
    """The best k of each slot."""
    slot, score, row = (np.concatenate(x) for x in zip(*heaps, strict=True))
    order = np.lexsort((row, -score, slot))
    slot, score, row = slot[order], score[order], row[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
    return slot[keep], score[keep], row[keep]


def bars(heap: Heap, slots: int, k: int, least: np.ndarray) -> np.ndarray:
    """The score that a newcomer must reach in each slot: ``least``, or that of
    the last member of a full heap."""
    slot, score, _ = heap
    bar = least.copy()
    last = np.flatnonzero(np.arange(len(slot)) - np.searchsorted(slot, slot) == k - 1)
    bar[slot[last]] = np.maximum(bar[slot[last]], score[last])
    return bar


def runs_of(labels: np.ndarray) -> dict[int, slice]:
    """label -> its rows, for sorted labels."""
    values, start, count = np.unique(labels, return_index=True, return_counts=True)
    return {v: slice(s, s + c) for v, s, c in zip(values.tolist(), start.tolist(), count.tolist(), strict=True)}


class Group:
    """Rows of one group in order of (label, id)."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, width: int):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, "<i4").reshape(len(self.ids), width).astype(np.int64)
        self.runs = runs_of(self.labels)


def positives(anchors: Group, others: Group, k: int, tile: int = TILE) -> Heap:
    """Each anchor's best k candidates of its label but itself; a slot is an anchor's row."""
    found = [empty_heap()]
    for label, rows in anchors.runs.items():
        if label in others.runs:
            heap, mine = empty_heap(), anchors.vectors[rows]
            least = np.full(rows.stop - rows.start, np.iinfo(np.int64).min)
            for start in range(others.runs[label].start, others.runs[label].stop, tile):
                part = slice(start, min(start + tile, others.runs[label].stop))
                scores = strassen(mine, others.vectors[part].T)
                able = scores >= bars(heap, len(mine), k, least)[:, None]
                able &= anchors.ids[rows][:, None] != others.ids[part]
                at, ref = np.nonzero(able)
                heap = merged([heap, (at, scores[at, ref], others.ids[part][ref])], k)
            found.append((heap[0] + rows.start, heap[1], heap[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def negatives(anchors: Group, others: Group, best: Heap, k: int, per: int, tile: int = TILE) -> Heap:
    """The best k candidates of other labels in the window of each positive in
    ``best``; a slot is ``per`` times an anchor's row plus the positive's place."""
    place = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
    slots = len(anchors.ids) * per
    low, high = np.full(slots, 1), np.full(slots, 0)  # nothing is inside
    at = best[0] * per + place
    low[at], high[at] = -((-LOW * best[1]) // 100), HIGH * best[1] // 100
    heap = empty_heap()
    for start in range(0, len(others.ids), tile):
        part = slice(start, start + tile)
        scores = strassen(anchors.vectors, others.vectors[part].T)
        other = anchors.labels[:, None] != others.labels[part]
        bar = bars(heap, slots, k, low).reshape(-1, per)
        fresh = [heap]
        for j in range(per):
            able = (scores >= bar[:, j:j + 1]) & (scores <= high[j::per][:, None]) & other
            row, ref = np.nonzero(able)
            fresh.append((row * per + j, scores[row, ref], others.ids[part][ref]))
        heap = merged(fresh, k)
    return heap


def cleaned(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, q) of the rows that take part, a row per id, q as integers."""
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE))
    whole = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & label.isNotNull() & whole)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("q"))
    return cut(rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("one")).select("id", "one.label", "one.q"))


def packed(rows: DataFrame, groups: int, width: int, seed: int) -> DataFrame:
    """(part, ids, labels, vectors): one row per group of about equal size."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("id", "ascending")])
        q = np.zeros((t.num_rows, width), "<i4")
        column = t.column("q").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(t.num_rows), sizes)
        q[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
        cols = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "label")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": [cols[0]], "labels": [cols[1]], "vectors": [q.tobytes()]})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).cast("int"))
    return cut(dealt.groupBy("part").applyInArrow(run, "part int, ids binary, labels binary, vectors binary"))


HEAP = "slots binary, scores binary, rows binary"


def heap_row(heap: Heap) -> dict:
    return {c: pa.array([x.astype("<i8").tobytes()], pa.binary()) for c, x in zip(("slots", "scores", "rows"), heap, strict=True)}


def heap_of(row: dict) -> Heap:
    return tuple(np.frombuffer(row[c], "<i8") for c in ("slots", "scores", "rows"))


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def meet(anchors: DataFrame, others: DataFrame, a_groups: int, o_groups: int, width: int, work) -> DataFrame:
    """(a, o, heap) of every group of anchors with every group of candidates.
    A task reads a group of anchors, then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = group = None
        for r in one_by_one(batches):
            now = Group(r["ids"], r["labels"], r["vectors"], width)
            if r["o_side"] == 0:
                row, group = r, now
            elif row is not None and row["a"] == r["a"]:
                found = work(group, now, heap_of(row) if row["slots"] is not None else empty_heap())
                yield pa.RecordBatch.from_pydict({"a": pa.array([r["a"]], pa.int32()), "o": pa.array([r["o"]], pa.int32()), **heap_row(found)})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumnRenamed("part", "a").withColumn("o", each(o_groups)).withColumn("o_side", F.lit(0))
    right = others.withColumnRenamed("part", "o").withColumn("a", each(a_groups)).withColumn("o_side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    if "slots" not in both.columns:
        both = both.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("slots", "scores", "rows")])
    tasks = min(a_groups * o_groups, 100_000)
    dealt = both.repartitionById(tasks, ((F.col("a").cast("bigint") * o_groups + F.col("o")) % tasks).cast("int"))
    return dealt.sortWithinPartitions("a", "o", "o_side").mapInArrow(run, f"a int, o int, {HEAP}")


def merge_all(heaps: DataFrame, parts: int, k: int) -> DataFrame:
    """(a, heap): the heaps (a, o, heap) of all candidates' groups merged, ``FAN`` at a time."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, o = (x.as_py() for x in key)
        heap = merged([heap_of(r) for r in t.to_pylist()], k)
        return pa.table({"a": pa.array([a], pa.int32()), "o": pa.array([o], pa.int32()), **heap_row(heap)})

    while True:
        heaps = heaps.withColumn("o", F.expr(f"cast(o div {FAN} as int)")).groupBy("a", "o").applyInArrow(run, f"a int, o int, {HEAP}")
        parts = -(-parts // FAN)
        if parts <= 1:
            return cut(heaps.drop("o"))


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
         anchor: Column | None = None, n_pos: int = POSITIVES, n_neg: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) of all rows as candidates; ``label`` may be any integer
    column, ``anchor`` (of the id) says which rows are anchors, all by default."""
    rows = cleaned(vectors, id_col, vec_col, F.col("label") if label is None else label)
    anchor = F.lit(True) if anchor is None else anchor
    n, n_anchors, width, largest = rows.select(anchor.alias("is"), "q").agg(
        F.count(F.lit(1)), F.count_if("is"), F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    width, largest = max(width or 0, 1), largest or 0
    if largest >= 1 << 31 or largest * largest * width >= 1 << 56:
        raise ArithmeticError(f"a score of components of {largest} and a width of {width} may exceed 64 bits")
    spark = vectors.sparkSession
    share = math.ceil(n / (3 * spark.sparkContext.defaultParallelism))
    a_groups = max(1, math.ceil(n_anchors / ANCHOR_ROWS))
    o_groups = max(1, math.ceil(n / min(CANDIDATE_ROWS, max(share, 1024))))
    anchors = packed(rows.where(anchor), a_groups, width, 1).withColumnRenamed("part", "a")
    others = packed(rows, o_groups, width, 2)
    left = anchors.withColumnRenamed("a", "part")
    best = merge_all(meet(left, others, a_groups, o_groups, width, lambda a, o, _: positives(a, o, n_pos, TILE)), o_groups, n_pos)
    held = anchors.join(best, "a").withColumnRenamed("a", "part")
    found = merge_all(meet(held, others, a_groups, o_groups, width, lambda a, o, heap: negatives(a, o, heap, n_neg, n_pos, TILE)), o_groups, n_neg)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            ids = np.frombuffer(r["ids"], "<i8")
            at, p_score, p_id = heap_of({c: r["p_" + c] for c in ("slots", "scores", "rows")})
            place = at * n_pos + np.arange(len(at)) - np.searchsorted(at, at)
            slot, score, row = heap_of(r)
            pos = np.searchsorted(place, slot)
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot) + 1
            yield pa.RecordBatch.from_pydict({
                "anchor_id": ids[slot // n_pos], "positive_id": p_id[pos], "rank": pa.array(rank, pa.int32()), "negative_id": row,
                "positive_score": p_score[pos], "negative_score": score})

    named = best.withColumnsRenamed({c: "p_" + c for c in ("slots", "scores", "rows")})
    return (anchors.select("a", "ids").join(named, "a").join(found, "a")
            .mapInArrow(rows_of, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                 "negative_score bigint"))


#: The fixed query's anchors and labels.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10


def report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every 50th id; labels of every 7th are moved on by one."""
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors, label=moved, anchor=F.col("id") % ANCHOR_EVERY == 0)


def oracle() -> str:
    """``report`` as DuckDB SQL."""
    return f"""WITH _r AS (SELECT vec_id AS id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
_s AS (SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
  CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM _r a JOIN _r b ON a.id <> b.id WHERE a.id % {ANCHOR_EVERY} = 0),
_p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM _s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM _p p JOIN _s s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= {NEGATIVES}"""
