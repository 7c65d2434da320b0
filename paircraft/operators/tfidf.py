"""TF-IDF as tables.

A fitted model is a vocabulary table (term, df, idf); documents become long
(key, term, weight) tables; the row-wise sparse dot product of a pair is a
join on (key, term) plus a sum. Definitions follow the common vectorizer
defaults: raw or sublinear ``1 + ln(tf)`` term frequency, smooth idf
``ln((1 + N) / (1 + df)) + 1``, L2 row normalisation, integer ``min_df``.
Spark's ``IDF`` estimator uses ``ln((N + 1) / (df + 1))`` without the ``+1``,
so it is not used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paircraft.functions import text as T
from paircraft.operators import coded_terms
from paircraft.schema import CHAR_MIN_DF, CHAR_NGRAMS, WORD_MIN_DF, WORD_NGRAMS
from paircraft.session import checkpointed


def term_frequencies(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf): explode the term array and count (partial aggregation
    before the shuffle on (key, term)). ``explode_outer`` + a null filter:
    a plain ``explode`` makes the optimizer infer a ``size(terms) > 0``
    filter that re-inlines the whole n-gram expression below the projection
    (and evaluates the token regex once per n-gram)."""
    return (docs.select(key, F.explode_outer(terms).alias("term"))
                .where(F.col("term").isNotNull())
                .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class TfidfModel:
    vocab: DataFrame        # (term, df, idf)
    sublinear: bool

    def transform(self, tf: DataFrame, key: str) -> DataFrame:
        """(key, term, w) with rows L2-normalised; out-of-vocabulary terms are
        dropped. The vocabulary joins on ``term`` (AQE broadcasts it when its
        measured size is small, otherwise shuffles)."""
        tfv = F.log(F.col("tf")) + 1.0 if self.sublinear else F.col("tf").cast("double")
        w0 = tf.join(self.vocab.select("term", "idf"), "term").select(key, "term", (tfv * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
        return w0.select(key, "term", (F.col("w") / norm).alias("w"))


def fit_idf(tf: DataFrame, key: str, n_docs: Column, min_df: int = 1,
            sublinear: bool = False) -> TfidfModel:
    """Document frequency per term with the ``min_df`` cut (A17) and smooth
    idf. ``n_docs`` counts every document of the fit corpus, also those
    without any term (a scalar Column, e.g. a scalar subquery)."""
    return idf_of(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs, min_df, sublinear)


def idf_of(df: DataFrame, n_docs: Column, min_df: int = 1, sublinear: bool = False) -> TfidfModel:
    """``fit_idf`` of counted terms (term, df)."""
    df = df.where(F.col("df") >= min_df)
    vocab = df.select("term", "df", (F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    return TfidfModel(vocab, sublinear)


def pair_cosine(pairs: DataFrame, weights: DataFrame, key: str = "qkey",
                k1: str = "qkey1", k2: str = "qkey2", out: str = "cosine") -> DataFrame:
    """Row-wise sparse dot product of L2-normalised rows (J4), once per
    distinct pair of texts, so that a text that many pairs hold does not
    multiply its terms: equal texts have 1 (0 without weights), the others
    join terms(k1) with terms(k2) on (k2, term); pairs without a shared term
    get 0 through the final left join."""
    p = pairs.select(k1, k2).distinct()
    t1 = weights.select(F.col(key).alias(k1), "term", F.col("w").alias("w1"))
    t2 = weights.select(F.col(key).alias(k2), "term", F.col("w").alias("w2"))
    dots = (p.where(F.col(k1) != F.col(k2)).join(t1, k1).join(t2, [k2, "term"])
             .groupBy(k1, k2).agg(F.sum(F.col("w1") * F.col("w2")).alias("_dot")))
    known = weights.select(F.col(key).alias(k1)).distinct()
    same = p.where(F.col(k1) == F.col(k2)).join(known, k1).select(k1, k2, F.lit(1.0).alias("_dot"))
    return (pairs.join(dots.unionByName(same), [k1, k2], "left")
                 .withColumn(out, F.coalesce(F.col("_dot"), F.lit(0.0))).drop("_dot"))


#: Characters of the texts of a block, about: a task holds the terms of one block.
BLOCK_CHARS = 8_000_000
#: Blocks of characters for one of words: a character gives three terms.
CHAR_BLOCKS = 2
#: Rounds in which the blocks of a large table are dealt, at most: the disk holds the shuffle files of one.
ROUNDS = 4

VECTOR = "entries binary, n int, top double, norm double"


def packed(ids: np.ndarray, tf: np.ndarray, df: np.ndarray) -> bytes:
    """The entries of a text in the order of their ids: steps from one to the
    next of ids and document frequencies, which are small, and counts; equal
    bytes side by side, only as many of a number as it takes (their numbers
    come first), compressed."""
    step = np.diff(np.stack([ids, df]), prepend=0)
    planes = [x.astype("<i8").view(np.uint8).reshape(-1, 8).T[:max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)] for x in (*((step << 1) ^ (step >> 63)), tf)]
    return bytes(len(p) for p in planes) + pa.compress(b"".join(p.tobytes() for p in planes), "zstd", asbytes=True)


def unpacked(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = list(b[:3])
    x = np.frombuffer(pa.decompress(b[3:], n * sum(sizes), "zstd"), np.uint8)
    out, at = [], 0
    for k in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = x[at:at + k * n].reshape(k, n).T
        out.append(wide.reshape(-1).view("<i8"))
        at += k * n
    ids, df = (np.cumsum((step >> 1) ^ -(step & 1)) for step in out[:2])
    return ids, out[2], df


def weighted(tf: np.ndarray, df: np.ndarray, top: float | np.ndarray, sublinear: bool) -> np.ndarray:
    """tf x idf; ``top`` is ln(1 + N)."""
    return (np.log(tf) + 1.0 if sublinear else tf.astype(float)) * (top - np.log(df + 1.0) + 1.0)


def text_vectors(texts: DataFrame, text_col: str, terms_of, vocab: DataFrame, sublinear: bool) -> DataFrame:
    """(qkey, entries, n, top, norm): the TF-IDF vector of each distinct text in
    one row: ids of its ``n`` known terms in order with counts and document
    frequencies (``packed``), ln(1 + N) of the fit (sign: minus for a raw tf),
    and the length to divide by. ``terms_of`` is "word" or "char", or adds the
    array column ``terms``.

    The texts are dealt into blocks, whose terms are made as numbers
    (``coded_terms``); a block asks once for the idf of each of its distinct
    terms, so that no (text, term) row is shuffled. ``vocab``
    (term, df, smooth idf) is a checkpoint: the ids are the places of its rows,
    the first of all partitions, then the second and so on, frequent terms first.

    Blocks beyond those that the cores take at a time are dealt in rounds; each
    is written as a checkpoint, and its shuffle files are let go before the next."""
    chars = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS)) * (CHAR_BLOCKS if terms_of == "char" else 1)
    rounds = min(ROUNDS, -(-blocks // texts.sparkSession.sparkContext.defaultParallelism))
    parts = vocab.rdd.getNumPartitions()
    top = vocab.agg(F.max(F.col("idf") - 1.0 + F.log(F.col("df") + 1.0))).scalar()
    place = F.monotonically_increasing_id()  # the partition's number times 2^33, and the row's in it
    named = vocab.sortWithinPartitions(F.desc("df"), "term").select("term", "df", (place % (1 << 33) * parts + F.shiftright(place, 33)).alias("id"))
    how = terms_of if isinstance(terms_of, str) else "list"

    def ask(own: pa.Table) -> pa.Table:
        terms = coded_terms.distinct_terms(own, how)
        at = own.column("p")[0].as_py()
        return pa.table({"at": pa.array(np.full(len(terms), at, np.int64)), "term": terms})

    def run(own: pa.Table, idf: pa.Table) -> pa.Table:
        idf = idf.sort_by("id")
        row, place, tf, terms = coded_terms.counted(own, how)
        at = pc.index_in(terms, value_set=idf.column("term").combine_chunks()).fill_null(-1).to_numpy()[place]
        there = at >= 0
        size = max(idf.num_rows, 1)
        code, tf = row[there].astype(np.int64) * size + at[there], tf[there]
        del row, place, at, there
        order = np.argsort(code)
        code, tf = code[order], tf[order].astype(np.int64)
        row, place = code // size, code % size
        ids, df = (idf.column(c).to_numpy()[place] for c in ("id", "df"))
        top = idf.column("top")[0].as_py() if idf.num_rows else 0.0
        v = weighted(tf, df, top, sublinear)
        norm = np.sqrt(np.bincount(row, v * v, own.num_rows))
        ends = np.searchsorted(row, np.arange(own.num_rows + 1))
        entries = [packed(ids[a:b], tf[a:b], df[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"qkey": own.column("qkey"), "entries": pa.array(entries, pa.binary()), "n": pa.array(np.diff(ends), pa.int32()),
                         "top": pa.array(np.full(own.num_rows, top if sublinear else -top)), "norm": norm})

    found = None
    for i in range(rounds):
        some = texts.select("qkey", text_col, F.pmod(F.xxhash64("qkey"), F.lit(blocks)).alias("p")).where(F.col("p") % rounds == i)
        # the keys are read by both readers of ``dealt``, so that they share one shuffle
        dealt = coded_terms.with_pieces(some.repartition("p"), text_col, terms_of)[0].select("p", "qkey", "text", "given")
        asked = dealt.groupBy("p").applyInArrow(ask, "at bigint, term string")
        known = asked.join(named, "term").select("at", "term", "id", "df", top.alias("top"))
        own = checkpointed(dealt.groupBy("p").cogroup(known.groupBy("at")).applyInArrow(run, f"qkey string, {VECTOR}"))
        found = own if found is None else found.unionByName(own)
    return found


def vector_cosine(pairs: DataFrame, vectors: DataFrame, k1: str = "qkey1", k2: str = "qkey2", out: str = "cosine") -> DataFrame:
    """``pair_cosine`` of ``text_vectors``: a pair meets two packed rows, not a
    row for each term."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            got = np.zeros(b.num_rows)
            for i, (x1, m1, top, norm1, x2, m2, _, norm2) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 10)), strict=True)):
                (ids1, tf1, df), (ids2, tf2, _) = unpacked(x1, m1), unpacked(x2, m2)
                _, a, z = np.intersect1d(ids1, ids2, assume_unique=True, return_indices=True)
                if len(a):
                    v1, v2 = (weighted(tf, df[a], abs(top), top > 0) for tf in (tf1[a], tf2[z]))
                    got[i] = (v1 / norm1) @ (v2 / norm2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], [k1, k2, "_dot"])

    p = pairs.select(k1, k2).distinct()
    side = lambda k, i: vectors.select(F.col("qkey").alias(k), *[F.col(c).alias(f"{c}{i}") for c in ("entries", "n", "top", "norm")])
    met = p.where(F.col(k1) != F.col(k2)).join(side(k1, 1), k1).join(side(k2, 2), k2)
    found = (met.select(k1, k2, "entries1", "n1", "top1", "norm1", "entries2", "n2", "top2", "norm2")
             .mapInArrow(dots, f"{k1} string, {k2} string, _dot double"))
    known = vectors.where(F.col("norm") > 0).select(F.col("qkey").alias(k1))
    same = p.where(F.col(k1) == F.col(k2)).join(known, k1).select(k1, k2, F.lit(1.0).alias("_dot"))
    return (pairs.join(found.unionByName(same), [k1, k2], "left")
                 .withColumn(out, F.coalesce(F.col("_dot"), F.lit(0.0))).drop("_dot"))


def weight_sums(vectors: DataFrame) -> DataFrame:
    """(qkey, n_terms, sum_w, max_w) of ``text_vectors``: number, sum and
    largest of a text's L2-normalised weights; texts without known terms have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.zeros((2, b.num_rows))
            for i, (x, n, top, norm) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                _, tf, df = unpacked(x, n)
                w = weighted(tf, df, abs(top), top > 0) / norm
                sums[:, i] = w.sum(), w.max()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int64()), pa.array(sums[0]), pa.array(sums[1])], ["qkey", "n_terms", "sum_w", "max_w"])
    return (vectors.where("n > 0").select("qkey", "entries", "n", "top", "norm")
            .mapInArrow(run, "qkey string, n_terms bigint, sum_w double, max_w double"))


def with_terms(df: DataFrame, text_col: str, analyzer: str, out: str = "terms") -> DataFrame:
    """Word 1-2-grams or char 3-5-grams of ``text_col`` as an array column."""
    if analyzer == "word":
        return T.with_word_ngrams(df, text_col, out, *WORD_NGRAMS)
    return T.with_char_ngrams(df, text_col, out, *CHAR_NGRAMS)


def pair_term_frequencies(qtab: DataFrame, analyzer: str = "word", text_col: str = "clean") -> DataFrame:
    # The texts are dealt by key before their n-grams are made: that also
    # serves the (key, term) counts and the per-key window of ``transform``,
    # so no n-gram is shuffled for either.
    dealt = qtab.select("qkey", text_col).repartition("qkey")
    return term_frequencies(with_terms(dealt, text_col, analyzer), "qkey", F.col("terms"))


def fit_distinct(texts: DataFrame, analyzer: str = "word", text_col: str = "clean", fit_on: DataFrame | None = None) -> TfidfModel:
    """The model of ``fit_pair_tfidf`` of texts with a row each (``qkey`` is
    unique): the terms of many texts are counted as numbers before a row a term
    is sent (``coded_terms``), so texts are shuffled for ``fit_on`` only."""
    min_df = WORD_MIN_DF if analyzer == "word" else CHAR_MIN_DF
    seen = texts.select("qkey", text_col)
    n = (seen if fit_on is None else fit_on).agg(F.count(F.lit(1))).scalar()
    if fit_on is not None:
        seen = seen.join(fit_on, "qkey", "left_semi")
    return idf_of(coded_terms.document_frequencies(seen, text_col, analyzer), n, min_df, sublinear=(analyzer == "word"))


def fit_pair_tfidf(qtab: DataFrame, analyzer: str = "word", text_col: str = "clean",
                   tf: DataFrame | None = None, fit_on: DataFrame | None = None):
    """Fit on a question table (qkey, clean): word n-grams 1-2 with
    ``min_df=3`` and sublinear tf, or char n-grams 3-5 with ``min_df=10`` (M1).
    Returns (model, weights table of the corpus). ``tf`` may pass a ready
    (qkey, term, tf) table; ``fit_on`` (qkey) bounds the fit to some of the
    texts, as a rule those of the training pairs, while all are transformed."""
    min_df = WORD_MIN_DF if analyzer == "word" else CHAR_MIN_DF
    if tf is None:
        tf = pair_term_frequencies(qtab, analyzer, text_col)
    n = (qtab if fit_on is None else fit_on).agg(F.count(F.lit(1))).scalar()
    seen = tf if fit_on is None else tf.join(fit_on, "qkey", "left_semi")
    model = fit_idf(seen, "qkey", n, min_df, sublinear=(analyzer == "word"))
    return model, model.transform(tf, "qkey")
