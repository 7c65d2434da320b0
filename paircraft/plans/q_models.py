"""Registered queries of the pair features, their reduction and the experts
on them (M3-M12, M14, X10, X11, J6, P2, S8, S11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paircraft.operators import experts, lsh, split, term_svd
from paircraft.operators.feature_blocks import PairFeatures, PairFeaturesModel, PairReducer, PairTexts, fit_expert
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.plans.q_eda import _NUMERIC, EDA, numeric_sql
from paircraft.plans.q_sources import _SPLIT
from paircraft.plans.q_text import _Q, _cosine_sql
from paircraft.schema import SPLIT_CUTS, SPLIT_SEED
from paircraft.session import ensure_checkpoint_dir
from paircraft.sources import fixtures as fx
from paircraft.sources import metric_log, model_store
from paircraft.sources.tables import table

R = O.R


# ---------------------------------------------------------------- split and text measures
@register("group_split_exact", _SPLIT + f""",
_g AS (SELECT grp, row_number() OVER (ORDER BY concat_ws('-', md5(concat(grp, '-', '{SPLIT_SEED}')), CAST(grp AS VARCHAR))) AS pos,
  count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM _split))
SELECT s.pair_id, s.grp, CASE WHEN pos <= floor(n * {SPLIT_CUTS[0]} / 100) THEN 'train'
  WHEN pos <= floor(n * {SPLIT_CUTS[1]} / 100) THEN 'valid' ELSE 'test' END AS split FROM _split s JOIN _g USING (grp)""")
def group_split_exact(spark, sf):
    """80/10/10 split whose cuts are exact to one group."""
    return split.group_split_exact(fx.pair_ids(spark, sf)).select("pair_id", "grp", "split")


@register("encode_texts", O.with_(O.DOC_PAIRS, _Q) + f""",
_c AS (SELECT qkey, [CAST(unicode(ch) AS BIGINT) FOR ch IN string_split(lower(question), '')] AS cp FROM _q),
_p AS (SELECT qkey, unnest(cp) AS c, generate_subscripts(cp, 1) AS i FROM _c),
_n AS (SELECT qkey, c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS d FROM _p WINDOW w AS (PARTITION BY qkey ORDER BY i)),
_h AS (SELECT qkey, ((a * {experts.NGRAM_STEP} + b) % {experts.NGRAM_MODULUS} * {experts.NGRAM_STEP} + d) % {experts.NGRAM_MODULUS} % 384 AS h
  FROM _n WHERE d IS NOT NULL),
_k AS (SELECT qkey, h, count(*) AS n FROM _h GROUP BY qkey, h),
_m AS (SELECT qkey, map_from_entries(list((h, n))) AS counts, sqrt(sum(n * n)) AS norm FROM _k GROUP BY qkey)
SELECT qkey, [{R('CAST(coalesce(counts[x], 0) / norm AS FLOAT)')} FOR x IN range(384)] AS embedding FROM _q LEFT JOIN _m USING (qkey)
WHERE norm IS NOT NULL
UNION ALL SELECT qkey, [0.0 FOR x IN range(384)] FROM _q WHERE qkey NOT IN (SELECT qkey FROM _m)""")
def encode_texts(spark, sf):
    """Distinct question texts encoded by the built-in hashed n-gram encoder,
    384 wide, unit norm (M14)."""
    q = fx.pair_texts(spark, sf)
    return experts.encode_texts(q, "question", "qkey", dim=384).select("qkey", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _ratios(spark, sf):
    return fx.materialize(spark, "text_ratios", sf, lambda: experts.text_ratios(
        fx.keyed_pairs(spark, sf).select("pair_id", "qkey1", "qkey2"), fx.pair_texts(spark, sf)))


@register("edit_ratio")
def edit_ratio(spark, sf):
    """Indel edit similarity of the two whole texts of each pair."""
    return _ratios(spark, sf).select("pair_id", F.col("edit").alias("ratio"))


@register("token_set_ratio")
def token_set_ratio(spark, sf):
    """Token-set similarity of each pair (X11)."""
    return _ratios(spark, sf).select("pair_id", F.col("token_set").alias("ratio"))


# ---------------------------------------------------------------- native features
def _block_sql() -> str:
    fuzzy = f"""SELECT pair_id, CAST(abs({O.char_count('question1')} - {O.char_count('question2')}) AS DOUBLE) AS cd,
  CAST(abs({O.word_count('question1')} - {O.word_count('question2')}) AS DOUBLE) AS wd
  FROM doc_pairs WHERE question1 IS NOT NULL AND question2 IS NOT NULL"""
    return f"""SELECT w.pair_id, list_transform(list_concat([w.cosine, c.cosine, f.cd, f.wd, e.jaccard], n.numeric), lambda x: {R('x')}) AS features,
  CAST(len(n.numeric) + 5 AS INTEGER) AS width
FROM ({_cosine_sql('word')}) w JOIN ({_cosine_sql('char')}) c USING (pair_id) JOIN ({O.with_(O.DOC_PAIRS)} {fuzzy}) f USING (pair_id)
JOIN ({EDA} SELECT pair_id, jaccard FROM _eda) e USING (pair_id) JOIN ({_NUMERIC} {numeric_sql()}) n USING (pair_id)"""


@register("raw_feature_block", _block_sql())
def raw_feature_block(spark, sf):
    """Native feature blocks joined on pair_id and concatenated (M4, J5):
    word and char TF-IDF cosine, char/word count differences, Jaccard and the
    numeric block -> 23 numbers per pair."""
    from paircraft.functions.similarity import length_diffs
    from paircraft.operators import tfidf
    from paircraft.operators.features import numeric_block as nb, raw_features
    from paircraft.session import checkpointed
    kp = fx.keyed_pairs(spark, sf)
    # numbers are written, so that the vectors that pairs were joined with are let go
    cos = lambda name, out: checkpointed(tfidf.vector_cosine(kp, fx.tfidf_vectors(spark, sf, name), out=out).select("pair_id", out))
    cw, cc = cos("word", "cos_w"), cos("char", "cos_c")
    # characters and words are counted once for each distinct text; pairs join numbers
    sizes = fx.pair_texts(spark, sf).select("qkey", *[d.alias(n) for d, n in zip(length_diffs(F.col("question"), F.lit("")), ("c", "w"), strict=True)])
    side = lambda i: sizes.select(F.col("qkey").alias(f"qkey{i}"), F.col("c").alias(f"c{i}"), F.col("w").alias(f"w{i}"))
    fuzzy = kp.join(side(1), "qkey1").join(side(2), "qkey2").select(
        "pair_id", F.abs(F.col("c1") - F.col("c2")).alias("char_diff"), F.abs(F.col("w1") - F.col("w2")).alias("word_diff"))
    jac = fx.eda_pairs(spark, sf).select("pair_id", "jaccard")
    num = nb(None, fx.measured_pairs(spark, sf)).select("pair_id", "numeric")
    return raw_features([cw, cc, fuzzy, jac, num]).select("pair_id", "features", F.size("features").alias("width"))


# ---------------------------------------------------------------- SVD of the term matrix
def _term_svd(spark, sf, analyzer: str, k: int):
    """Fitted on the texts of all pairs, as the reference does."""
    _, w = fx.tfidf_fit(spark, sf, analyzer)
    return term_svd.fit_term_svd(w, "qkey", k).transform(w, "qkey")


@register("term_svd_word")
def term_svd_word(spark, sf):
    """Each text's 150 components of the word TF-IDF matrix (M3)."""
    return _term_svd(spark, sf, "word", 150)


@register("term_svd_char")
def term_svd_char(spark, sf):
    """Each text's 100 components of the character TF-IDF matrix (M3)."""
    return _term_svd(spark, sf, "char", 100)


# ---------------------------------------------------------------- all features
def pair_features(spark, sf):
    """(pair_id, split, label, features): 526 + 4 x 384 numbers, fitted on the
    training pairs, built once per application."""
    def build():
        pairs = split.group_split(fx.doc_pairs(spark, sf).dropna(subset=["question1", "question2"]))
        texts = PairTexts(pairs)
        model = PairFeatures(passes=3).fit_texts(texts.part(pairs.where("split = 'train'")))
        rows = pairs.select("pair_id", "split", F.col("is_duplicate").alias("label"))
        return rows.join(model.block(texts), "pair_id")
    return fx.materialize(spark, "pair_features", sf, build)


def reduced_pairs(spark, sf):
    """(pair_id, split, label, reduced): PCA to 95% of the training variance."""
    def build():
        f = pair_features(spark, sf)
        return PairReducer().fit(f.where("split = 'train'")).transform(f).drop("features")
    return fx.materialize(spark, "reduced_pairs", sf, build)


@register("pair_features")
def pair_features_q(spark, sf):
    """All 2,062 features of every pair."""
    return pair_features(spark, sf).select("pair_id", "split", "label", F.size("features").alias("width"), "features")


@register("pca_projection")
def pca_projection(spark, sf):
    """Centred PCA of the 2,062 features, fitted on the training pairs, to the
    components that hold 95% of the variance (M5, W2)."""
    return reduced_pairs(spark, sf).select("pair_id", F.col("reduced").alias("pca"))


# ---------------------------------------------------------------- experts
def _expert(spark, sf, kind: str):
    rows = reduced_pairs(spark, sf)
    model = fit_expert(rows.where("split = 'train'"), kind)
    return model.predict(rows, "reduced", "p").select("pair_id", "split", "p")


@register("expert_lr")
def expert_lr(spark, sf):
    """Balanced logistic regression on the PCA-reduced pair features."""
    return _expert(spark, sf, "lr")


@register("expert_gbt")
def expert_gbt(spark, sf):
    """400 boosted trees of depth 7, rate 0.05, row and column share 0.9, on
    histograms of the reduced features (M7)."""
    return _expert(spark, sf, "gbt")


@register("expert_gbt_deep")
def expert_gbt_deep(spark, sf):
    """600 boosted trees grown best-first to 64 leaves, rate 0.05 (M8)."""
    return _expert(spark, sf, "gbt_deep")


@register("expert_rf")
def expert_rf(spark, sf):
    """Forest of 200 unbounded trees, split >= 5, leaf >= 2."""
    return _expert(spark, sf, "rf")


@register("expert_svm_calibrated")
def expert_svm_calibrated(spark, sf):
    """Squared-hinge linear SVM with 3-fold sigmoid calibration."""
    return _expert(spark, sf, "svm")


@register("expert_knn")
def expert_knn(spark, sf):
    """Ten nearest training pairs among the reduced features, found by
    projections, vote by inverse distance (J6, M9)."""
    from paircraft.operators.knn import knn_vote
    rows = reduced_pairs(spark, sf).withColumn("id", F.xxhash64("pair_id"))
    train = rows.where("split = 'train'")
    near = lsh.knn_join_lsh(rows, train, 10, vec="reduced")
    return rows.join(knn_vote(near, train, y="label"), F.col("id") == F.col("qid")).select("pair_id", "split", F.col("score").alias("p"))


@register("knn_join_lsh")
def knn_join_lsh(spark, sf):
    """Ten approximate nearest neighbours of every stored vector by bucketed
    random projections (J6)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return lsh.knn_join_lsh(e, e, 10)


# ---------------------------------------------------------------- stores
@register("stored_features", _NUMERIC + f"""
SELECT pair_id, list_transform([CAST(l1 AS DOUBLE), CAST(l2 AS DOUBLE), CAST(ld AS DOUBLE)], lambda x: {R('x')}) AS lengths FROM _bb""")
def stored_features(spark, sf):
    """The numeric and overlap blocks fitted, kept by their content, loaded
    instead of fitted again, and applied (S8): the lengths of both sides."""
    store = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    # texts stand in their table once; pairs, and what they are known by, are content keys
    texts = PairTexts(fx.keyed_pairs(spark, sf), fx.pair_questions(spark, sf))
    stage = PairFeatures(blocks=["overlap", "numeric"])
    for _ in range(2):
        model = model_store.load_or_fit(stage, texts.keys, PairFeaturesModel, store, lambda: stage.fit_texts(texts))
    return model.block(texts).select("pair_id", F.slice("features", 2, 3).alias("lengths"))


@register("pending_run_files", O.with_(O.RUNS) + """
SELECT run_id, model, lr, epochs FROM runs WHERE epochs = 10""")
def pending_run_files(spark, sf):
    """Runs whose file is not among those that a glob finds (S11, F6): runs of
    fewer than ten epochs have one."""
    root = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    runs = fx.runs(spark, sf).select("run_id", "model", "lr", "epochs")
    name = F.concat(F.lit("gate_"), "model", F.lit("_lr"), F.format_string("%.3f", "lr"), F.lit("_ep"), F.col("epochs").cast("string"))
    done = runs.where("epochs <> 10").select(name.alias("file"), F.col("model").alias("value")).distinct()
    done.repartition("file").write.partitionBy("file").text(root)
    return metric_log.without_file(runs, metric_log.found_runs(spark, f"{root}/file=gate_*"))
