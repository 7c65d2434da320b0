"""Registered text queries: cleaning, tokens, n-grams, TF-IDF, similarity
(X1-X9, X11, X13-X15, A17, M1, J1, J4, U1, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircraft.functions import text as T
from paircraft.functions.similarity import set_containment, set_jaccard
from paircraft.operators import tables, tfidf
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.plans.ordered import ordered_cumsum
from paircraft.schema import CHAR_MIN_DF, HTML_RE, MATH_RE, SPLIT_CUTS, SPLIT_SEED, WORD_MIN_DF
from paircraft.sources import fixtures as fx
from paircraft.sources.tables import table

R = O.R

# ------------------------------------------------------------------ cleaning


@register("ascii_fold", f"SELECT doc_id, {O.ascii_fold('text')} AS folded FROM documents")
def ascii_fold(spark, sf):
    """NFKD fold to ASCII + lower case of every document."""
    return table(spark, sf, "documents").select("doc_id", T.ascii_fold("text").alias("folded"))


@register("strip_markup", f"""SELECT page_id,
  regexp_replace(regexp_replace(html, {O.lit(MATH_RE)}, ' ', 'g'),
                 {O.lit(HTML_RE)}, ' ', 'g') AS text FROM pages""")
def strip_markup(spark, sf):
    """Remove [math] blocks and HTML tags from raw pages."""
    return table(spark, sf, "pages").select("page_id", T.strip_markup("html").alias("text"))


@register("clean_nostem", f"SELECT doc_id, {O.clean_nostem('text')} AS clean FROM documents")
def clean_nostem(spark, sf):
    """Fold, strip markup, keep basic characters, tokenise, drop stop words."""
    return table(spark, sf, "documents").select("doc_id", T.clean_nostem("text").alias("clean"))


@register("question_meta_nostem", f"""WITH _c AS (SELECT doc_id, {O.clean_nostem('text')} AS clean FROM documents)
SELECT doc_id, CAST(length(clean) AS BIGINT) AS clean_len, {O.word_count('clean')} AS clean_words FROM _c""")
def question_meta_nostem(spark, sf):
    """Cleaned text statistics: char length and word count of the cleaned
    text (X9, no-stem variant)."""
    c = table(spark, sf, "documents").select("doc_id", T.clean_nostem("text").alias("clean"))
    return c.select("doc_id", T.char_count("clean").alias("clean_len"), T.word_count("clean").alias("clean_words"))


# ------------------------------------------------------------------ pair similarity
_NN = "WHERE question1 IS NOT NULL AND question2 IS NOT NULL"


@register("jaccard", O.with_(O.DOC_PAIRS) + f"""
SELECT pair_id, {R(O.set_jaccard(O.jaccard_set('question1'), O.jaccard_set('question2')))} AS jaccard
FROM doc_pairs {_NN}""")
def jaccard_q(spark, sf):
    """Token-set Jaccard of each pair, stop words removed."""
    return fx.pair_sets(spark, sf).select("pair_id", set_jaccard("_s1", "_s2").alias("jaccard"))


@register("token_containment", O.with_(O.DOC_PAIRS) + f"""
SELECT pair_id, {R(O.set_containment(O.jaccard_set('question1'), O.jaccard_set('question2')))} AS containment
FROM doc_pairs {_NN}""")
def token_containment(spark, sf):
    """Share of the smaller token set found in the other (X11 native part)."""
    return fx.pair_sets(spark, sf).select("pair_id", set_containment("_s1", "_s2").alias("containment"))


@register("fuzzy_block", O.with_(O.DOC_PAIRS) + f"""
SELECT pair_id, abs({O.char_count('question1')} - {O.char_count('question2')}) AS char_diff,
       abs({O.word_count('question1')} - {O.word_count('question2')}) AS word_diff
FROM doc_pairs {_NN}""")
def fuzzy_block(spark, sf):
    """Char and word count differences of each pair."""
    from paircraft.functions.similarity import length_diffs
    p = tables.drop_null_pairs(fx.doc_pairs(spark, sf))
    return p.select("pair_id", *length_diffs("question1", "question2"))


# ------------------------------------------------------------------ questions and keys
_Q = """_q AS (SELECT DISTINCT md5(q) AS qkey, q AS question FROM
        (SELECT question1 AS q FROM doc_pairs UNION ALL SELECT question2 FROM doc_pairs) WHERE q IS NOT NULL)"""


@register("distinct_questions", O.with_(O.DOC_PAIRS, _Q) + """
SELECT qkey, CAST(length(question) AS BIGINT) AS n_chars FROM _q""")
def distinct_questions(spark, sf):
    """Distinct texts over both pair columns, keyed by content hash."""
    q = tables.distinct_questions(fx.doc_pairs(spark, sf))
    return q.select("qkey", T.char_count("question").alias("n_chars"))


@register("question_dim", O.with_(O.DOC_PAIRS, _Q) + """
SELECT qkey, row_number() OVER (ORDER BY qkey) AS qidx FROM _q""")
def question_dim(spark, sf):
    """Dense 1-based id per distinct question in key order (W4): a
    range-partitioned running count, not a single-task global window."""
    q = tables.distinct_questions(fx.doc_pairs(spark, sf)).select("qkey", F.lit(1).cast("bigint").alias("one"))
    return ordered_cumsum(q, "qkey", ["one"]).select("qkey", F.col("cum_one").alias("qidx"))


@register("resolve_pairs", O.with_(O.DOC_PAIRS, _Q) + """
SELECT p.pair_id, a.qkey AS qkey1, b.qkey AS qkey2 FROM doc_pairs p
JOIN _q a ON a.qkey = md5(p.question1) JOIN _q b ON b.qkey = md5(p.question2)""")
def resolve_pairs(spark, sf):
    """Both sides of each pair resolved to question keys."""
    p = fx.doc_pairs(spark, sf)
    q = tables.distinct_questions(p)
    return tables.require_resolved(p, q).select("pair_id", "qkey1", "qkey2")


@register("unresolved_pairs", O.with_(O.DOC_PAIRS, """
_lq AS (SELECT DISTINCT md5(d.text) AS qkey FROM documents d JOIN labels l ON l.doc_id = d.doc_id
        WHERE d.text IS NOT NULL)""") + """
SELECT DISTINCT pair_id FROM doc_pairs p
WHERE md5(p.question1) NOT IN (SELECT qkey FROM _lq) OR md5(p.question2) NOT IN (SELECT qkey FROM _lq)""")
def unresolved_pairs(spark, sf):
    """Pairs with a side missing from the question table of labelled
    documents (left anti joins, J1 error path)."""
    keys = fx.doc_keys(spark, sf)
    labelled = table(spark, sf, "labels").select("doc_id")
    lq = keys.where(F.col("k").isNotNull()).join(labelled, "doc_id", "left_semi").select(F.col("k").alias("qkey")).distinct()
    return tables.unresolved_pairs(fx.with_doc_keys(fx.pair_ids(spark, sf), keys), lq)


# ------------------------------------------------------------------ n-grams and TF-IDF
def _word_grams_sql(tok: str) -> str:
    return (f"list_concat({tok}, list_transform(range(1, len({tok})), "
            f"lambda i: {tok}[i] || ' ' || {tok}[i + 1]))")


def _char_grams_sql(s: str) -> str:
    parts = [f"list_transform(range(1, length({s}) - {n} + 2), lambda i: substring({s}, i, {n}))"
             for n in (3, 4, 5)]
    return f"list_concat({parts[0]}, list_concat({parts[1]}, {parts[2]}))"


@register("word_ngrams", f"""WITH _c AS (SELECT doc_id, {O.clean_nostem('text')} AS clean FROM documents),
_t AS (SELECT doc_id, {O.word_tokens('clean')} AS tk FROM _c),
_g AS (SELECT doc_id, {_word_grams_sql('tk')} AS g FROM _t)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct FROM _g""")
def word_ngrams(spark, sf):
    """Word 1-2-grams of each cleaned document: total and distinct."""
    c = table(spark, sf, "documents").select("doc_id", T.clean_nostem("text").alias("clean"))
    g = tfidf.with_terms(c, "clean", "word", "g")
    return g.select("doc_id", F.size("g").cast("bigint").alias("n_grams"),
                    F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"))


_CHAR_NORM = "regexp_replace(lower(clean), '\\s\\s+', ' ', 'g')"


@register("char_ngrams", f"""WITH _c AS (SELECT doc_id, {O.clean_nostem('text')} AS clean FROM documents),
_s AS (SELECT doc_id, {_CHAR_NORM} AS s FROM _c),
_g AS (SELECT doc_id, {_char_grams_sql('s')} AS g FROM _s)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct FROM _g""")
def char_ngrams(spark, sf):
    """Character 3-5-grams of each cleaned document: total and distinct."""
    c = table(spark, sf, "documents").select("doc_id", T.clean_nostem("text").alias("clean"))
    g = tfidf.with_terms(c, "clean", "char", "g")
    return g.select("doc_id", F.size("g").cast("bigint").alias("n_grams"),
                    F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"))


def _tfidf_ctes(analyzer: str) -> str:
    if analyzer == "word":
        min_df, tfv = WORD_MIN_DF, "(1 + ln(tf))"
        src = (f"SELECT qkey, unnest({_word_grams_sql('tk')}) AS term FROM "
               f"(SELECT qkey, {O.word_tokens('clean')} AS tk FROM _qc)")
    else:
        min_df, tfv = CHAR_MIN_DF, "tf"
        src = (f"SELECT qkey, unnest({_char_grams_sql('s')}) AS term FROM "
               f"(SELECT qkey, {_CHAR_NORM} AS s FROM _qc)")
    return O.with_(O.DOC_PAIRS, _Q, f"""
_qc AS (SELECT qkey, {O.clean_nostem('question')} AS clean FROM _q),
_tf AS (SELECT qkey, term, count(*) AS tf FROM ({src}) GROUP BY qkey, term),
_fitp AS (SELECT * FROM doc_pairs {_NN} AND ('0x' || substr(md5(concat(least(qid1, qid2), '-', '{SPLIT_SEED}')), 1, 8))::BIGINT % 100 < {SPLIT_CUTS[0]}),
_fitq AS (SELECT md5(question1) AS qkey FROM _fitp UNION SELECT md5(question2) FROM _fitp),
_n AS (SELECT count(*) AS n FROM _fitq),
_voc AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
         FROM _tf JOIN _fitq USING (qkey), _n GROUP BY term HAVING count(*) >= {min_df}),
_w0 AS (SELECT qkey, term, {tfv} * idf AS w FROM _tf JOIN _voc USING (term)),
_w AS (SELECT qkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY qkey)) AS w FROM _w0)""")


def _cosine_sql(analyzer: str) -> str:
    return _tfidf_ctes(analyzer) + f""",
_pk AS (SELECT pair_id, md5(question1) AS k1, md5(question2) AS k2 FROM doc_pairs {_NN}),
_pa AS MATERIALIZED (SELECT p.pair_id, p.k2, a.term, a.w FROM _pk p JOIN _w a ON a.qkey = p.k1),
_dot AS (SELECT pa.pair_id, sum(pa.w * b.w) AS dot FROM _pa pa JOIN _w b ON b.qkey = pa.k2 AND b.term = pa.term
         GROUP BY pa.pair_id)
SELECT p.pair_id, {R('coalesce(d.dot, 0.0)')} AS cosine FROM _pk p LEFT JOIN _dot d USING (pair_id)"""


@register("term_df", _tfidf_ctes("word") + f"""
SELECT term, df, {R('idf')} AS idf FROM _voc""")
def term_df(spark, sf):
    """Vocabulary of the word model: document frequency >= min_df and smooth
    idf (A17, X15)."""
    return fx.tfidf_model(spark, sf, "word").vocab


@register("tfidf_weights", _tfidf_ctes("word") + f"""
SELECT qkey, count(*) AS n_terms, {R('sum(w)')} AS sum_w, {R('max(w)')} AS max_w FROM _w GROUP BY qkey""")
def tfidf_weights(spark, sf):
    """Per question: number of weighted terms, sum and max of the
    L2-normalised sublinear TF-IDF weights (X15)."""
    return tfidf.weight_sums(fx.tfidf_vectors(spark, sf, "word"))


@register("tfidf_word_cosine", _cosine_sql("word"))
def tfidf_word_cosine(spark, sf):
    """Word 1-2-gram TF-IDF cosine of each pair."""
    kp = fx.keyed_pairs(spark, sf)
    return tfidf.vector_cosine(kp, fx.tfidf_vectors(spark, sf, "word")).select("pair_id", "cosine")


@register("tfidf_char_cosine", _cosine_sql("char"))
def tfidf_char_cosine(spark, sf):
    """Char 3-5-gram TF-IDF cosine of each pair."""
    kp = fx.keyed_pairs(spark, sf)
    return tfidf.vector_cosine(kp, fx.tfidf_vectors(spark, sf, "char")).select("pair_id", "cosine")
