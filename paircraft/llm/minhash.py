"""Document fingerprints by MinHash.

A text's set holds its 5-word shingles (words are lower-cased runs without
ASCII white space; a shorter text is one shingle). Each of ``PERMUTATIONS``
universal hash functions h(x) = (a x + b) mod 2^64, a odd, orders the shingles;
the signature keeps the upper 32 bits of each minimum, the fingerprint shows
the upper 16 of them as four hex digits. The minima of a whole document are
taken block by block, so that memory does not grow with its length.

``near_duplicates`` bands the signatures, joins equal bands in Spark and
verifies every candidate by its exact Jaccard similarity.

Null and empty texts have the signature of the empty set (all ones), are alike
among themselves (1.0) and near-duplicates of nothing. Equal texts have equal
fingerprints; repeated rows are kept; a null id sorts first; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import WordCodes, cut, mix, n_parts, shingles, slices, words
from paircraft.llm.jaccard_join import link

PERMUTATIONS = 128
BANDS = 32
THRESHOLD = 0.75
SEED = 20
#: Shingles that are permuted at once.
BLOCK = 1024


def permutations(k: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, (2, k, 1), np.uint64) << np.uint64(1)
    return a[0] | np.uint64(1), a[1] | rng.integers(0, 2, (k, 1), np.uint64)


class Signer:
    """Signatures of one task; keeps the words' hashes."""

    def __init__(self, k: int = PERMUTATIONS):
        self.a, self.b = permutations(k)
        self.codes = WordCodes()

    def minima(self, x: np.ndarray) -> np.ndarray:
        """Smallest 64-bit value of each permutation over the shingles ``x``."""
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), BLOCK):
            v = self.a * x[None, i:i + BLOCK]
            v += self.b
            np.minimum(out, v.min(axis=1), out=out)
        return out

    def minima_of(self, text: str | None) -> np.ndarray:
        return self.minima(shingles(self.codes.of(words(text))))

    def both(self, text: str, edited: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Minima of a text and of its edited form, whose first ``kept`` code
        points are the same; shingles inside that part are permuted once."""
        m = max(len(words(text[:kept])) - 1, 0)  # the last word may go on
        tw, ew = words(text), words(edited)
        tc = self.codes.of(tw)
        ec = np.concatenate([tc[:m], self.codes.of(ew[m:])])
        if min(len(tc), len(ec)) < 5:
            return self.minima(shingles(tc)), self.minima(shingles(ec))
        same = max(m - 4, 0)
        common = self.minima(shingles(tc[:m])) if same else self.minima(tc[:0])
        return (np.minimum(common, self.minima(shingles(tc[same:]))),
                np.minimum(common, self.minima(shingles(ec[same:]))))


def shown(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    return (minima >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, after: str) -> tuple[str, int]:
    """The last quarter of ``text`` replaced by the beginning of ``after``;
    also the number of code points kept."""
    k = len(text) // 4
    return text[:len(text) - k] + after[:k], len(text) - k


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string, signature binary of 32-bit minima, n_shingles) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Signer()
        for b in slices(batches):
            x = [shingles(s.codes.of(words(t))) for t in b.column(1).to_pylist()]
            m = [s.minima(v) for v in x]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([shown(v).tobytes().hex() for v in m]),
                pa.array([(v >> np.uint64(32)).astype("<u4").tobytes() for v in m], pa.binary()),
                pa.array([len(np.unique(v)) for v in x], pa.int64())],
                ["id", "fingerprint", "signature", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, fingerprint string, signature binary, n_shingles bigint")


def with_next_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (at, ghost, id, tie, text), partitioned by the range ``at`` of the id and
    sorted in it; the first row of each range is also the last, marked as a
    ghost, of the range before (the first of all: of the last range), so that
    each row's successor is the next row of its own partition.

    The ranges are quantiles of the id; their number is that of the
    partitions, which also bounds what the driver sees: a quantile and the
    smallest key of each range."""
    n = n_parts(docs)
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    cuts = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_at").transform(
        d.withColumn("_x", F.coalesce(F.col("id").cast("double"), F.lit(-1e300))))
    ranged = ranged.select(F.col("_at").cast("int").alias("at"), "id", "tie", "text")
    firsts = sorted((r.at, r.k) for r in ranged.groupBy("at").agg(F.min(F.struct("id", "tie")).alias("k")).collect())
    spark = docs.sparkSession
    ghosts = spark.createDataFrame(
        [(at, k.id, k.tie, firsts[i - 1][0]) for i, (at, k) in enumerate(firsts)],
        "g_at int, g_id bigint, g_tie bigint, to int")
    hit = ranged.join(F.broadcast(ghosts), (F.col("at") == F.col("g_at")) & F.col("id").eqNullSafe(F.col("g_id"))
                      & F.col("tie").eqNullSafe(F.col("g_tie")), "left")
    own = F.struct(F.col("at"), F.lit(0).alias("ghost"))
    copy = F.struct(F.col("to").alias("at"), F.lit(1).alias("ghost"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))
    out = hit.select(F.explode(places).alias("p"), "id", "tie", "text").select("p.at", "p.ghost", "id", "tie", "text")
    return (out.repartitionById(max(len(splits) - 1, 1), F.col("at"))
            .sortWithinPartitions("at", "ghost", "id", "tie"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (see ``edit``; the
    text that follows in id order, after the last the first, gives the new
    end), and the likeness to the edited form's and to the next document's."""

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, rows = Signer(), []
        prev = None  # (range, id, text) of the row before: its successor gives the new end
        wait = None  # the row before that one: it still needs prev's fingerprint

        def finish(row: tuple, later: np.ndarray) -> None:
            doc, n, sha, mine, fixed = row
            rows.append((doc, n, sha, mine.tobytes().hex(), fixed.tobytes().hex(),
                         likeness(mine, fixed), likeness(mine, later)))

        for b in slices(batches):
            for at, ghost, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                text = text or ""
                if prev is not None and prev[0] == at:
                    edited, kept = edit(prev[2], text)
                    mine, fixed = map(shown, s.both(prev[2], edited, kept))
                    if wait is not None:
                        finish(wait, mine)
                    wait = (prev[1], len(prev[2]), hashlib.sha256(edited.encode()).hexdigest(), mine, fixed)
                    if ghost:  # the range ends here
                        finish(wait, shown(s.minima_of(text)))
                        wait = None
                prev = None if ghost else (at, doc, text)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            rows.clear()

    out = with_next_in_order(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(id, component_id): documents linked by a verified Jaccard similarity of
    at least ``threshold`` whose signatures share a band; component_id is the
    smallest id that links reach. At 32 bands of 4 rows a pair of similarity
    0.75 is found with probability 0.99999."""
    rows = PERMUTATIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Signer()
        for b in slices(batches):
            sets = [np.unique(shingles(s.codes.of(words(t)))) for t in b.column(1).to_pylist()]
            hashed = []
            for x in sets:
                m, h = s.minima(x).reshape(bands, rows), np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    h = mix(h ^ m[:, r])
                hashed.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int32()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                pa.array(hashed, pa.list_(pa.int64()))], ["id", "node", "n", "keys", "bands"])

    told = cut(docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(
        run, "id bigint, node bigint, n int, keys array<bigint>, bands array<bigint>"))
    nodes = told.where("n > 0").dropDuplicates(["node"])
    found = link(nodes.select("node", "n", "keys"), nodes.select(F.explode("bands").alias("key"), "node"), round(100 * threshold))
    named = told.select("id", "n", F.col("node").alias("set")).join(
        found.withColumnRenamed("node", "linked"), F.col("set") == F.col("linked"), "left")
    named = named.select("id", "n", F.coalesce("component", "set").alias("class"))
    first = named.where("n > 0").groupBy("class").agg(F.min("id").alias("component_id"))
    return named.where("n > 0").join(first, "class").select(F.col("id").alias(id_col), "component_id").unionByName(
        named.where("n = 0").select(F.col("id").alias(id_col), F.col("id").alias("component_id")))
