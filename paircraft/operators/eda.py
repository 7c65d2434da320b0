"""Exploratory aggregates over pair tables.

All are single-pass hash aggregations (partial + final); quantiles use the
exact distributed plan of ``paircraft.plans.ordered``; no row data reaches
the driver.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.functions.binning import qcut_bin, width_bucket
from paircraft.functions.text import drop_stop_words
from paircraft.session import checkpointed, ensure_checkpoint_dir
from paircraft.plans.ordered import exact_quantiles, quantile_edges, value_counts


def class_balance(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """Rows, positives, negatives, positive ratio (A1)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col(label)).cast("bigint").alias("dup_count"),
                  F.sum(1 - F.col(label)).cast("bigint").alias("nondup_count"),
                  F.avg(F.col(label).cast("double")).alias("dup_ratio"))


def length_means(df: DataFrame) -> DataFrame:
    """Mean char and word counts per side (A2); input from ``pair_lengths``."""
    return df.agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}")
                    for c in ("q1_len", "q2_len", "q1_words", "q2_words", "len_diff")])


def term_counts(df: DataFrame, tokens_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, freq): token occurrences; explode + partial aggregation."""
    return (df.select(*by, F.explode_outer(tokens_col).alias("term")).where(F.col("term").isNotNull())
              .groupBy(*by, "term").agg(F.count(F.lit(1)).alias("freq")))


def top_k(df: DataFrame, k: int, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Top-k rows overall (TakeOrderedAndProject: per-partition top-k, then a
    k-row merge) or per group (row_number over a window per group; groups
    here are a few labels). Adds a 1-based ``rank`` (W1)."""
    from pyspark.sql import Window
    if not by:
        # row_number over the k-row result only
        top = df.orderBy(*order).limit(k)
        w = Window.orderBy(*order)
        return top.withColumn("rank", F.row_number().over(w).cast("bigint"))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def top_words(df: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent terms of ``q1 + " " + q2`` without stop words (A3): the
    default vectorizer token rule on lower case."""
    toks = F.regexp_extract_all(
        F.lower(F.concat_ws(" ", F.coalesce("question1", F.lit("")), F.coalesce("question2", F.lit("")))),
        F.lit(r"(?U)\b\w\w+\b"), 0)
    t = df.select(drop_stop_words(toks).alias("toks"))
    tc = term_counts(t, "toks")
    return top_k(tc, k, [F.col("freq").desc(), F.col("term").asc()])


def mean_std(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Mean and sample standard deviation (A4, A5)."""
    return df.agg(F.avg(col).alias(f"mean_{prefix}"), F.stddev_samp(col).alias(f"std_{prefix}"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long Pearson matrix (a, b, corr) over all column pairs, one aggregation
    (A6)."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {stack}) as (a, b, corr)")


def corr_with_label(df: DataFrame, cols: Sequence[str], label: str = "is_duplicate") -> DataFrame:
    """Correlation of each column with the label, ranked by |corr|."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) as (feature, corr)")
    from pyspark.sql import Window
    w = Window.orderBy(F.abs("corr").desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w).cast("bigint"))  # len(cols) rows


def dup_rate_by_quantile(df: DataFrame, col: str, q: int = 10,
                         label: str = "is_duplicate") -> DataFrame:
    """Positive rate per quantile bin of ``col`` (A7, A8): exact edges at
    0, 1/q, ..., 1, duplicate edges dropped, right-closed bins.

    Output (bin, lo, hi, n, n_dup, dup_rate); ``bin`` is 1-based (W1).
    The edge array is a scalar subquery (one row of at most q+1 numbers).
    """
    # One scan: distinct values with row and positive counts; edges, bins and
    # rates are then computed on this (much smaller) table.
    # The table is read several times (edges, totals, bins): checkpoint it
    # once instead of recomputing the input for each read.
    vc = value_counts(df, col, extra={"pos": F.col(label).cast("bigint")}).checkpoint()
    edges_row = quantile_edges(None, col, q, counts=vc).select("edges").checkpoint()
    # scalar subqueries may not sit inside lambdas: project the edges first
    xe = vc.select("_x", "cnt", "pos", edges_row.scalar().alias("_edges"))
    b = xe.select(qcut_bin("_x", F.col("_edges")).alias("b"), "cnt", "pos")
    g = b.groupBy("b").agg(F.sum("cnt").alias("n"), F.sum("pos").cast("bigint").alias("n_dup"))
    edges = edges_row.scalar()
    hi_i = F.least(F.col("b") + 2, F.size(edges))
    return g.select((F.col("b") + 1).cast("int").alias("bin"),
                    F.element_at(edges, F.col("b") + 1).alias("lo"),
                    F.element_at(edges, hi_i).alias("hi"),
                    "n", "n_dup", (F.col("n_dup") / F.col("n")).alias("dup_rate"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] (A10): (bin, lo, hi, n)."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    mm = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo = mm.select("lo").scalar()
    hi = mm.select("hi").scalar()
    g = x.groupBy(width_bucket("x", lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return g.select("bin", (lo + (F.col("bin") - 1) * width).alias("lo"),
                    (lo + F.col("bin") * width).alias("hi"), "n")


def class_counts(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """Bars of a count plot (A10)."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Five-number summary per group (A10): exact min/q1/median/q3/max."""
    qs = exact_quantiles(df, col, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    names = ["min", "q1", "median", "q3", "max"]
    return qs.groupBy(*by).agg(*[F.max(F.when(F.col("q_idx") == i, F.col("value"))).alias(n)
                                 for i, n in enumerate(names)])


def kde_curve(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density on an equal grid over [min, max] with Scott's
    bandwidth ``n^(-1/5) * std`` (A12). Two aggregations; the grid is 50
    aggregate columns, so rows are never multiplied by the grid."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    st = x.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
               F.min("x").alias("lo"), F.max("x").alias("hi"))
    n, sd, lo, hi = (st.select(c).scalar() for c in ("n", "sd", "lo", "hi"))
    h = F.pow(n.cast("double"), -0.2) * sd
    step = (hi - lo) / (points - 1)
    grid = [lo + step * i for i in range(points)]
    sums = x.agg(*[F.sum(F.exp(-F.pow((g - F.col("x")) / h, 2) / 2)).alias(f"k{i}")
                   for i, g in enumerate(grid)])
    norm = n * h * math.sqrt(2 * math.pi)
    stack = ", ".join(f"{i}, `k{i}`" for i in range(points))
    long = sums.selectExpr(f"stack({points}, {stack}) as (i, ksum)")
    return long.select(F.col("i").cast("int").alias("i"), (lo + step * F.col("i")).alias("x"),
                       (F.col("ksum") / norm).alias("density"))


def similarity_group_terms(df: DataFrame, sim_col: str, tokens_col: str, k: int = 20,
                           high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Term frequencies in the high (> high) and low (< low) similarity groups,
    top-k per group: the data behind the word clouds (A11, F4)."""
    grp = F.when(F.col(sim_col) > high, F.lit("high")).when(F.col(sim_col) < low, F.lit("low"))
    t = df.select(grp.alias("grp"), tokens_col).where(F.col("grp").isNotNull())
    tc = term_counts(t, tokens_col, ["grp"])
    return top_k(tc, k, [F.col("freq").desc(), F.col("term").asc()], ["grp"])


def describe(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """count, mean, std, min, 25/50/75%, max per metric, exact (A14). Metrics
    are stacked to long form and grouped, so any number of metrics is one
    job."""
    stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = df.selectExpr(f"stack({len(metrics)}, {stack}) as (metric, value)")
    base = long.groupBy("metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"))
    qs = box_stats(long, "value", ["metric"]).withColumnsRenamed(
        {"q1": "p25", "median": "p50", "q3": "p75"})
    return base.join(qs, "metric")


def eda_cosine(pairs: DataFrame | None, kp: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """EDA cosine (M2): unigram TF-IDF with stop words removed, raw tf, smooth
    idf, **fitted on question1 only**, both sides transformed, L2 rows.

    Work is per distinct text, not per pair side: texts are tokenised once;
    the document frequency of a term is the sum, over question1 texts that
    contain it, of how often the text occurs as question1 (the same count as
    fitting on the question1 column); a text's weights are one packed row,
    and a pair joins two of them. ``texts`` may bring that count (``m1``), so
    that no text is shuffled for it. Returns (pair_id, cosine)."""
    from paircraft.functions.text import drop_stop_words, word_tokens
    from paircraft.operators import coded_terms, tfidf
    from paircraft.operators.tables import distinct_questions, text_key
    if kp is None:
        kp = pairs.select("pair_id", text_key("question1").alias("qkey1"), text_key("question2").alias("qkey2"))
        texts = distinct_questions(pairs)
    def terms_of(df: DataFrame) -> DataFrame:
        return df.withColumn("_tk", word_tokens("question")).withColumn("terms", drop_stop_words("_tk"))

    if "m1" not in texts.columns:
        texts = texts.join(kp.groupBy(F.col("qkey1").alias("qkey")).agg(F.count(F.lit(1)).alias("m1")), "qkey", "left")
    n = kp.agg(F.count(F.lit(1))).scalar()
    df = coded_terms.document_frequencies(texts.where("m1 > 0"), "question", terms_of, "m1")
    vocab = checkpointed(df.select("term", "df", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    vectors = tfidf.text_vectors(texts, "question", terms_of, vocab, sublinear=False)
    return tfidf.vector_cosine(kp, vectors).select("pair_id", "cosine")


def eda_table(pairs: DataFrame | None, kp: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Per-pair EDA columns: lengths, word counts, length difference,
    Jaccard, EDA cosine, minimum question frequency. Texts are measured once
    per distinct text; the pairs carry ids and keys only through the joins.
    ``kp`` (pair_id, qid1, qid2, is_duplicate, qkey1, qkey2; both texts not
    null) and ``texts`` (qkey, question) may be passed instead of ``pairs``."""
    from paircraft.functions.similarity import set_jaccard
    from paircraft.functions.text import char_count, joined_set, split_set, word_count
    from paircraft.operators.tables import attach_min_freq, distinct_questions, item_frequency, text_key
    if kp is None:
        ensure_checkpoint_dir(pairs.sparkSession)
        base = pairs.dropna(subset=["question1", "question2"])
        texts = checkpointed(distinct_questions(base))
        kp = base.select("pair_id", "qid1", "qid2", "is_duplicate", text_key("question1").alias("qkey1"),
                         text_key("question2").alias("qkey2"))
    kp = checkpointed(kp.select("pair_id", "qid1", "qid2", "is_duplicate", "qkey1", "qkey2"))
    told = texts.select("qkey", joined_set("question").alias("s"), char_count("question").alias("len"),
                        word_count("question").alias("words"))
    side = lambda i: told.select(F.col("qkey").alias(f"qkey{i}"), F.col("s").alias(f"_s{i}"),
                                 F.col("len").alias(f"q{i}_len"), F.col("words").alias(f"q{i}_words"))
    j = kp.join(side(1), "qkey1").join(side(2), "qkey2").select(
        "pair_id", "qid1", "qid2", "is_duplicate", "q1_len", "q2_len", "q1_words", "q2_words",
        F.abs(F.col("q1_len") - F.col("q2_len")).alias("len_diff"), split_set("_s1").alias("_s1"), split_set("_s2").alias("_s2"))
    # numbers only from here on: the sets that pairs were joined with are let go before the vectors are made
    j = checkpointed(j.withColumn("jaccard", set_jaccard("_s1", "_s2")).drop("_s1", "_s2"))
    mf = attach_min_freq(j, item_frequency(kp)).drop("freq1", "freq2")
    return mf.join(eda_cosine(None, kp.select("pair_id", "qkey1", "qkey2"), texts), "pair_id")
