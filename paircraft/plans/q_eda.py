"""Registered EDA queries over ``doc_pairs`` (A1-A14 and the minimum slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircraft.functions.similarity import jaccard
from paircraft.operators import eda, tables
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.sources import fixtures as fx


def _jaccard_pairs(spark, sf):
    """Non-null pairs with their Jaccard overlap, read from the materialised
    EDA table (one Jaccard computation per application)."""
    return fx.eda_pairs(spark, sf).select("pair_id", "is_duplicate", "jaccard")


_J = f"{O.set_jaccard(O.jaccard_set('question1'), O.jaccard_set('question2'))}"


def _dup_rate_sql(value_cte: str, q: int) -> str:
    probs = O.num_list([i / q for i in range(q + 1)])
    return f"""{value_cte},
_e AS (SELECT list_sort(list_distinct(quantile_cont(x, {probs}))) AS edges FROM _p),
_b AS (SELECT CASE WHEN len(edges) > 2 THEN len(list_filter(edges[2:len(edges) - 1], lambda t: t < x))
                   ELSE 0 END AS b, y, edges FROM _p, _e)
SELECT CAST(b + 1 AS INTEGER) AS bin, {O.R('edges[b + 1]')} AS lo, {O.R('edges[least(b + 2, len(edges))]')} AS hi,
       count(*) AS n, CAST(sum(y) AS BIGINT) AS n_dup, {O.R('sum(y) / count(*)')} AS dup_rate
FROM _b GROUP BY b, edges"""


JACCARD_VALUES = O.with_(O.DOC_PAIRS, f"""_p AS (SELECT {_J} AS x, is_duplicate AS y FROM doc_pairs
  WHERE question1 IS NOT NULL AND question2 IS NOT NULL)""")


@register("dup_rate_by_jaccard", _dup_rate_sql(JACCARD_VALUES, 10))
def dup_rate_by_jaccard(spark, sf):
    """Minimum slice: pairs -> null drop -> Jaccard -> exact deciles -> rate."""
    return eda.dup_rate_by_quantile(_jaccard_pairs(spark, sf), "jaccard", 10)


# ---------------------------------------------------------------- EDA table queries
EDA = O.with_(O.DOC_PAIRS, O.eda_base())
R = O.R
_COLS = ["q1_len", "q2_len", "len_diff", "jaccard", "cosine", "min_freq", "is_duplicate"]


def _eda(spark, sf):
    return fx.eda_pairs(spark, sf)


@register("class_balance", EDA + """
SELECT count(*) AS n, CAST(sum(is_duplicate) AS BIGINT) AS dup_count,
       CAST(sum(1 - is_duplicate) AS BIGINT) AS nondup_count, """ + R("avg(is_duplicate)") + """ AS dup_ratio
FROM _eda""")
def class_balance(spark, sf):
    """Count, positives, negatives and positive ratio (A1)."""
    return eda.class_balance(_eda(spark, sf))


@register("length_means", EDA + "\nSELECT " + ", ".join(
    f"{R(f'avg({c})')} AS mean_{c}" for c in ("q1_len", "q2_len", "q1_words", "q2_words", "len_diff")) + " FROM _eda")
def length_means(spark, sf):
    """Mean char / word counts per side and mean length difference (A2)."""
    return eda.length_means(_eda(spark, sf))


@register("pair_lengths", EDA + """
SELECT pair_id, q1_len, q2_len, q1_words, q2_words, len_diff FROM _eda""")
def pair_lengths_q(spark, sf):
    """Raw char and word counts per side, length difference."""
    return _eda(spark, sf).select("pair_id", "q1_len", "q2_len", "q1_words", "q2_words", "len_diff")


@register("eda_cosine", EDA + f"\nSELECT pair_id, {R('cosine')} AS cosine FROM _eda")
def eda_cosine(spark, sf):
    """Unigram TF-IDF cosine fitted on question1 only (M2)."""
    return _eda(spark, sf).select("pair_id", "cosine")


@register("cosine_stats", EDA + f"\nSELECT {R('avg(cosine)')} AS mean_cosine, {R('stddev_samp(cosine)')} AS std_cosine FROM _eda")
def cosine_stats(spark, sf):
    """Mean and sample standard deviation of the EDA cosine (A4)."""
    return eda.mean_std(_eda(spark, sf), "cosine", "cosine")


@register("jaccard_stats", EDA + f"\nSELECT {R('avg(jaccard)')} AS mean_jaccard, {R('stddev_samp(jaccard)')} AS std_jaccard FROM _eda")
def jaccard_stats(spark, sf):
    """Mean and sample standard deviation of the Jaccard overlap (A5)."""
    return eda.mean_std(_eda(spark, sf), "jaccard", "jaccard")


@register("corr_matrix", EDA + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM _eda"
    for a in _COLS for b in _COLS) + ")")
def corr_matrix(spark, sf):
    """Pearson correlation of every pair of EDA columns, long form."""
    return eda.corr_matrix(_eda(spark, sf), _COLS)


_FEATS = ["q1_len", "q2_len", "len_diff", "jaccard", "cosine", "min_freq"]


@register("corr_with_label", EDA + "\n, _c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(is_duplicate AS DOUBLE)) AS corr FROM _eda"
    for c in _FEATS) + f""")
SELECT feature, {R('corr')} AS corr, row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS rank FROM _c""")
def corr_with_label(spark, sf):
    """Correlation of each feature with the label, ranked by |corr|."""
    return eda.corr_with_label(_eda(spark, sf), _FEATS)


def _dup_rate_on(col: str, q: int):
    cte = EDA + f",\n_p AS (SELECT CAST({col} AS DOUBLE) AS x, is_duplicate AS y FROM _eda WHERE {col} IS NOT NULL)"
    return _dup_rate_sql(cte, q)


@register("dup_rate_by_len_diff", _dup_rate_on("len_diff", 10))
def dup_rate_by_len_diff(spark, sf):
    """Duplicate rate per exact decile of the length difference."""
    return eda.dup_rate_by_quantile(_eda(spark, sf), "len_diff", 10)


@register("dup_rate_by_cosine", _dup_rate_on("cosine", 10))
def dup_rate_by_cosine(spark, sf):
    """Duplicate rate per exact decile of the EDA cosine."""
    return eda.dup_rate_by_quantile(_eda(spark, sf), "cosine", 10)


@register("dup_rate_by_min_freq", _dup_rate_on("min_freq", 4))
def dup_rate_by_min_freq(spark, sf):
    """Duplicate rate per quartile of the minimum question frequency; equal
    edges collapse (A8)."""
    return eda.dup_rate_by_quantile(_eda(spark, sf), "min_freq", 4)


@register("histogram", EDA + f""",
_mm AS (SELECT min(jaccard) AS lo, max(jaccard) AS hi FROM _eda),
_h AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((jaccard - lo) * 50 / (hi - lo)) + 1, 50) END AS INTEGER) AS bin,
              lo, hi FROM _eda, _mm WHERE jaccard IS NOT NULL)
SELECT bin, {R('any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 50')} AS lo,
       {R('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 50')} AS hi, count(*) AS n FROM _h GROUP BY bin""")
def histogram(spark, sf):
    """50 equal-width bins of the Jaccard overlap (A10)."""
    return eda.histogram(_eda(spark, sf), "jaccard", 50)


@register("box_stats", EDA + f"""
SELECT is_duplicate, {R('quantile_cont(len_diff, 0.0)')} AS min, {R('quantile_cont(len_diff, 0.25)')} AS q1,
       {R('quantile_cont(len_diff, 0.5)')} AS median, {R('quantile_cont(len_diff, 0.75)')} AS q3,
       {R('quantile_cont(len_diff, 1.0)')} AS max FROM _eda GROUP BY is_duplicate""")
def box_stats(spark, sf):
    """Five-number summary of the length difference per class (A10)."""
    return eda.box_stats(_eda(spark, sf), "len_diff", ["is_duplicate"])


@register("kde_curve", EDA + f""",
_st AS (SELECT count(*) AS n, stddev_samp(jaccard) AS sd, min(jaccard) AS lo, max(jaccard) AS hi FROM _eda
        WHERE jaccard IS NOT NULL),
_g AS (SELECT i, lo + (hi - lo) / 49 * i AS x, n, pow(n, -0.2) * sd AS h FROM _st, range(0, 50) t(i))
SELECT CAST(i AS INTEGER) AS i, {R('any_value(g.x)')} AS x,
       {R('sum(exp(-pow((g.x - e.jaccard) / g.h, 2) / 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi()))')} AS density
FROM _g g, _eda e WHERE e.jaccard IS NOT NULL GROUP BY i""")
def kde_curve(spark, sf):
    """Gaussian kernel density of the Jaccard overlap on a 50-point grid,
    Scott bandwidth (A12)."""
    return eda.kde_curve(_eda(spark, sf), "jaccard", 50)


@register("top_words", O.with_(O.DOC_PAIRS) + f""",
_t AS (SELECT unnest(list_filter({O.word_tokens("concat_ws(' ', coalesce(question1, ''), coalesce(question2, ''))")},
                                 lambda tk: {O.not_stop('tk')})) AS term FROM doc_pairs
       WHERE question1 IS NOT NULL AND question2 IS NOT NULL),
_c AS (SELECT term, count(*) AS freq FROM _t GROUP BY term)
SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM _c ORDER BY freq DESC, term LIMIT 20""")
def top_words(spark, sf):
    """Twenty most frequent terms of q1 + q2 without stop words."""
    p = tables.drop_null_pairs(fx.doc_pairs(spark, sf))
    return eda.top_words(p, 20)


@register("similarity_group_terms", EDA + f""",
_t AS (SELECT CASE WHEN jaccard > 0.8 THEN 'high' WHEN jaccard < 0.2 THEN 'low' END AS grp,
              unnest(list_filter({O.word_tokens("concat_ws(' ', question1, question2)")}, lambda tk: {O.not_stop('tk')})) AS term
       FROM _eda WHERE jaccard > 0.8 OR jaccard < 0.2),
_c AS (SELECT grp, term, count(*) AS freq FROM _t GROUP BY grp, term),
_r AS (SELECT grp, term, freq, row_number() OVER (PARTITION BY grp ORDER BY freq DESC, term) AS rank FROM _c)
SELECT grp, term, freq, rank FROM _r WHERE rank <= 20""")
def similarity_group_terms(spark, sf):
    """Term frequencies in the high (> 0.8) and low (< 0.2) Jaccard groups,
    top 20 each: the data behind the word clouds (A11, F4)."""
    from paircraft.functions.text import drop_stop_words, word_tokens
    e = _eda(spark, sf).where("jaccard > 0.8 or jaccard < 0.2").select("pair_id", "jaccard")
    e = e.join(fx.doc_pairs(spark, sf).select("pair_id", "question1", "question2"), "pair_id")
    t = e.select("jaccard", word_tokens(F.concat_ws(" ", "question1", "question2")).alias("_tk")) \
         .select("jaccard", drop_stop_words("_tk").alias("toks"))
    return eda.similarity_group_terms(t, "jaccard", "toks", 20)


@register("question_freq", EDA + "\nSELECT qid, freq FROM _freq")
def question_freq(spark, sf):
    """Occurrences of each question id over both pair columns."""
    p = tables.drop_null_pairs(fx.doc_pairs(spark, sf))
    return tables.item_frequency(p)


@register("pair_min_freq", EDA + """
SELECT b.pair_id, coalesce(f1.freq, 0) AS freq1, coalesce(f2.freq, 0) AS freq2,
       least(coalesce(f1.freq, 0), coalesce(f2.freq, 0)) AS min_freq
FROM _base b LEFT JOIN _freq f1 ON f1.qid = b.qid1 LEFT JOIN _freq f2 ON f2.qid = b.qid2""")
def pair_min_freq(spark, sf):
    """Frequency of both sides of each pair and their minimum."""
    p = tables.drop_null_pairs(fx.doc_pairs(spark, sf))
    return tables.attach_min_freq(p, tables.item_frequency(p)).select("pair_id", "freq1", "freq2", "min_freq")


_SUMMARY = [
    ("train_rows", "count(*)", "%d", "F.count(F.lit(1))"),
    ("dup_count", "sum(is_duplicate)", "%d", None),
    ("nondup_count", "sum(1 - is_duplicate)", "%d", None),
    ("dup_ratio", "100.0 * avg(is_duplicate)", "%.3f%%", None),
    ("mean_q1_chars", "avg(q1_len)", "%.1f", None),
    ("mean_q2_chars", "avg(q2_len)", "%.1f", None),
    ("mean_q1_words", "avg(q1_words)", "%.1f", None),
    ("mean_q2_words", "avg(q2_words)", "%.1f", None),
    ("mean_len_diff", "avg(len_diff)", "%.1f", None),
    ("mean_jaccard", "avg(jaccard)", "%.3f", None),
    ("mean_cosine", "avg(cosine)", "%.3f", None),
    ("corr_min_freq_dup", "corr(CAST(min_freq AS DOUBLE), CAST(is_duplicate AS DOUBLE))", "%.3f", None),
]


def _summary_sql():
    parts = []
    for i, (name, expr, fmt, _) in enumerate(_SUMMARY):
        v = f"CAST({expr} AS BIGINT)" if fmt == "%d" else f"({expr})"
        parts.append(f"SELECT {i + 1} AS pos, '{name}' AS metric, printf('{fmt}', {v}) AS value FROM _eda")
    return EDA + "\nSELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@register("eda_summary", _summary_sql())
def eda_summary(spark, sf):
    """Twelve headline metrics as formatted strings, one aggregation."""
    e = _eda(spark, sf)
    aggs = []
    for i, (name, expr, fmt, _) in enumerate(_SUMMARY):
        v = F.expr(expr)
        aggs.append((F.format_string(fmt, v.cast("bigint") if fmt == "%d" else v)).alias(f"m{i}"))
    row = e.agg(*aggs)
    stack = ", ".join(f"{i + 1}, '{name}', m{i}" for i, (name, _, _, _) in enumerate(_SUMMARY))
    return row.selectExpr(f"stack({len(_SUMMARY)}, {stack}) as (pos, metric, value)")


# ---------------------------------------------------------------- feature blocks
_EDGES = O.num_list([0, 2, 4, 6, 8, 11, 16, 22, 31, 50, 1e6])


def _fixed_bin_sql(x: str) -> str:
    e = _EDGES
    return (f"CAST(CASE WHEN {x} IS NULL OR {x} < 0 OR {x} > 1e6 THEN 0 "
            f"ELSE len(list_filter({e}[2:10], lambda t: t < {x})) END AS INTEGER)")


@register("len_diff_bins", EDA + f"""
SELECT pair_id, len_diff, {_fixed_bin_sql('CAST(len_diff AS DOUBLE)')} AS len_bin FROM _eda""")
def len_diff_bins(spark, sf):
    """Fixed right-closed bins [0,2,4,6,8,11,16,22,31,50,1e6] of the length
    difference (X18)."""
    from paircraft.functions.binning import fixed_bin
    e = _eda(spark, sf)
    return e.select("pair_id", "len_diff", fixed_bin(F.col("len_diff").cast("double")).alias("len_bin"))


def _onehot_sql(idx: str, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda k: CASE WHEN k = {idx} THEN 1.0 ELSE 0.0 END)"


_NUMERIC = O.with_(O.DOC_PAIRS, f"""
_p AS (SELECT pair_id, md5(question1) AS k1, md5(question2) AS k2,
              {O.char_count(O.clean_nostem('question1'))} AS l1, {O.char_count(O.clean_nostem('question2'))} AS l2
       FROM doc_pairs WHERE question1 IS NOT NULL AND question2 IS NOT NULL),
_f AS (SELECT k, count(*) AS freq FROM (SELECT k1 AS k FROM _p UNION ALL SELECT k2 FROM _p) GROUP BY k),
_b AS (SELECT pair_id, l1, l2, abs(l1 - l2) AS ld, CAST(least(f1.freq, f2.freq) AS DOUBLE) AS mf
       FROM _p JOIN _f f1 ON f1.k = _p.k1 JOIN _f f2 ON f2.k = _p.k2),
_e AS (SELECT list_sort(list_distinct(quantile_cont(mf, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM _b),
_bb AS (SELECT pair_id, l1, l2, ld, mf, {_fixed_bin_sql('CAST(ld AS DOUBLE)')} AS len_bin,
               CASE WHEN len(edges) > 2 THEN len(list_filter(edges[2:len(edges) - 1], lambda t: t < mf)) ELSE 0 END AS mf_q
        FROM _b, _e)""")


def numeric_sql(rounded=lambda x: x) -> str:
    """(pair_id, len_bin, mf_quartile, numeric) of ``_bb``."""
    return f"""SELECT pair_id, len_bin, CAST(mf_q AS INTEGER) AS mf_quartile,
       list_transform(list_concat(list_concat([CAST(l1 AS DOUBLE), CAST(l2 AS DOUBLE), CAST(ld AS DOUBLE)], {_onehot_sql('len_bin', 10)}),
                                  list_concat([ln(1 + mf)], {_onehot_sql('mf_q', 4)})), lambda x: {rounded('x')}) AS numeric
FROM _bb"""


@register("numeric_block", _NUMERIC + "\n" + numeric_sql(R))
def numeric_block(spark, sf):
    """Numeric block of 18 per pair: cleaned lengths, difference, its bin
    one-hot, log1p of the minimum text frequency and its quartile one-hot
    (X18-X22)."""
    from paircraft.operators.features import numeric_block as nb
    return nb(None, fx.measured_pairs(spark, sf))
