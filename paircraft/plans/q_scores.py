"""Registered gate / subset / scorer queries (G1, G2, G4, G5, G8, J7, A16, T2,
M13) and the MLlib experts (rows-only checks)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from paircraft.operators import gate
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.plans.q_metrics import SCORES
from paircraft.sources import fixtures as fx

R = O.R
NAMES = list(fx.SCORE_EXPERTS)
K = len(NAMES)
# Fixed gate parameters of the checked forward / gradient queries.
W_FIX = [[0.5 if i == j else -0.25 for j in range(K)] for i in range(K)]
B_FIX = [0.1 * (i + 1) for i in range(K)]

PM = SCORES + """,
_pm AS (SELECT pair_id, """ + ", ".join(f"max(CASE WHEN expert = {O.lit(e)} THEN p END) AS {e}" for e in NAMES) + """,
        max(y) AS y FROM scores GROUP BY pair_id)"""


def _matrix(spark, sf):
    each = [F.max(F.when(F.col("expert") == e, F.col("p"))).alias(e) for e in NAMES]
    return fx.scores(spark, sf).groupBy("pair_id").agg(*each, F.max("y").alias("y"))


@register("gate_predict", PM + f"""
SELECT pair_id, {R(gate.forward_exprs(NAMES, W_FIX, B_FIX)['s'])} AS score FROM _pm""")
def gate_predict(spark, sf):
    """Softmax-gated blend of the expert scores with fixed parameters (G1)."""
    return gate.predict(_matrix(spark, sf), NAMES, W_FIX, B_FIX).select("pair_id", "score")


def _grad_sql():
    dW, dz = gate.gradient_exprs(NAMES, "y", W_FIX, B_FIX)
    parts = [f"SELECT 'W' AS param, {i} AS i, {j} AS j, {R(f'avg({e})')} AS grad FROM _pm" for (i, j), e in dW.items()]
    parts += [f"SELECT 'b', {i}, 0, {R(f'avg({e})')} FROM _pm" for i, e in dz.items()]
    return PM + "\nSELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@register("gate_gradient", _grad_sql())
def gate_gradient(spark, sf):
    """Mean BCE gradient of the gate at fixed parameters, one aggregation."""
    return gate.gradient(_matrix(spark, sf), NAMES, "y", W_FIX, B_FIX)


def _zero_params():
    return {m: ([[0.0] * K for _ in range(K)], [0.0] * K) for m in gate.masks(K)}


def _subset_grad_sql():
    parts = []
    for m in gate.masks(K):
        key = gate.subset_key(NAMES, m)
        dW, dz = gate.gradient_exprs(NAMES, "y", *_zero_params()[m], m)
        parts += [f"SELECT '{key}' AS subset, 'W' AS param, {i} AS i, {j} AS j, {R(f'avg({e})')} AS grad FROM _pm"
                  for (i, j), e in dW.items()]
        parts += [f"SELECT '{key}', 'b', {i}, 0, {R(f'avg({e})')} FROM _pm" for i, e in dz.items()]
    return PM + "\nSELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@register("subset_gate_gradient", _subset_grad_sql())
def subset_gate_gradient(spark, sf):
    """Gate gradients of every expert subset at zero parameters in one
    aggregation (G5)."""
    return gate.subset_gradients(_matrix(spark, sf), NAMES, "y", NAMES, _zero_params())


def _subset_ll_sql():
    parts = []
    for m in gate.masks(K):
        s = "(" + " + ".join(NAMES[i] for i in m) + f") / {len(m)}"
        pc = f"least(greatest({s}, 1.1920929e-07), {repr(1 - 1.1920929e-07)})"
        parts.append(f"SELECT '{gate.subset_key(NAMES, m)}' AS subset, {len(m)} AS k, "
                     f"avg(-(y * ln({pc}) + (1 - y) * ln(1 - {pc}))) AS log_loss FROM _pm")
    return PM + ",\n_ll AS (" + " UNION ALL ".join(parts) + ")"


@register("expert_subsets", _subset_ll_sql() + f"\nSELECT subset, k, {R('log_loss')} AS log_loss FROM _ll")
def expert_subsets(spark, sf):
    """Every non-empty expert subset with the log-loss of its equal-weight
    blend (J7, G4, G8)."""
    return gate.mean_blend_losses(_matrix(spark, sf), NAMES, "y", NAMES)


@register("top10_subsets", _subset_ll_sql() + f"""
SELECT subset, {R('log_loss')} AS log_loss, row_number() OVER (ORDER BY log_loss, subset) AS rank
FROM _ll ORDER BY log_loss, subset LIMIT 10""")
def top10_subsets(spark, sf):
    """Ten best subsets by log-loss (T2, G6 selection)."""
    ll = gate.mean_blend_losses(_matrix(spark, sf), NAMES, "y", NAMES)
    top = ll.orderBy("log_loss", "subset").limit(10)
    return top.select("subset", "log_loss",
                      F.row_number().over(Window.orderBy("log_loss", "subset")).cast("long").alias("rank"))


@register("best_subset", _subset_ll_sql() + f"""
SELECT arg_min(subset, log_loss) AS subset, {R('min(log_loss)')} AS log_loss FROM _ll""")
def best_subset(spark, sf):
    """Arg-min subset of the log-loss."""
    ll = gate.mean_blend_losses(_matrix(spark, sf), NAMES, "y", NAMES)
    return ll.agg(F.min_by("subset", "log_loss").alias("subset"), F.min("log_loss").alias("log_loss"))


@register("score_pairs", O.with_(O.DOC_PAIRS) + f"""
SELECT pair_id, {R(O.set_jaccard(O.jaccard_set('question1'), O.jaccard_set('question2')))} AS p
FROM doc_pairs WHERE question1 IS NOT NULL AND question2 IS NOT NULL""")
def score_pairs(spark, sf):
    """Batch inference through a pluggable Python scorer (M13): the scorer
    factory runs once per Python worker, pairs arrive in Arrow batches."""
    from paircraft.operators.experts import score_pairs as sp, token_jaccard_factory
    p = fx.doc_pairs(spark, sf).dropna(subset=["question1", "question2"])
    return sp(p, token_jaccard_factory()).select("pair_id", "p")


# ---------------------------------------------------------------- rows-only (R)
def _split_matrix(spark, sf):
    """Score matrix by split: (train, valid, test)."""
    from paircraft.operators.split import group_split
    m = _matrix(spark, sf).join(group_split(fx.pair_ids(spark, sf)).select("pair_id", "split"), "pair_id")
    return tuple(m.where(F.col("split") == x) for x in ("train", "valid", "test"))


@register("gate_fit")
def gate_fit(spark, sf):
    """Full-batch Adam fit of the softmax gate on the training scores until
    its early stop on the validation split (G2, G3): the best parameters."""
    train, valid, _ = _split_matrix(spark, sf)
    fitted = gate.fit(train, NAMES, "y", lr=0.05, epochs=100, valid=valid)
    rows = [("W", i, j, float(fitted.W[i][j])) for i in range(K) for j in range(K)]
    rows += [("b", i, 0, float(fitted.b[i])) for i in range(K)]
    return spark.createDataFrame(rows, "param string, i int, j int, value double")


def _search(spark, sf):
    """Gates of all subsets x learning rates, fitted together on the training
    rows for up to 200 epochs; the rate stays as it is (G5, G7)."""
    from paircraft.schema import GATE_LR_GRID
    key = fx.memo_key(spark, "gate_search", sf)
    if key not in fx._MEMO:
        train, valid, _ = _split_matrix(spark, sf)
        gates = [(m, lr) for m in gate.masks(K) for lr in GATE_LR_GRID]
        fx._MEMO[key] = gate.fit_many(train, NAMES, "y", gates, epochs=200, lr_patience=None, valid=valid)
    return fx._MEMO[key]


@register("grid_search")
def grid_search(spark, sf):
    """(subset, lr, best_epoch, valid_log_loss) of every subset and learning rate."""
    out = [(gate.subset_key(NAMES, f.members), f.lr, f.best_epoch, float(f.best)) for f in _search(spark, sf)]
    return spark.createDataFrame(out, "subset string, lr double, best_epoch int, valid_log_loss double")


@register("subset_search")
def subset_search(spark, sf):
    """Best rate, epoch and validation loss of each subset's trained gate."""
    best = {}
    for f in _search(spark, sf):
        if f.members not in best or f.best < best[f.members].best:
            best[f.members] = f
    out = [(gate.subset_key(NAMES, m), len(m), f.lr, f.best_epoch, float(f.best)) for m, f in best.items()]
    return spark.createDataFrame(out, "subset string, k int, lr double, best_epoch int, valid_log_loss double")


@register("expert_pair_vector_lr")
def expert_pair_vector_lr(spark, sf):
    """Logistic head on [|u-v|, u*v] of the stored vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from paircraft.functions.similarity import pair_vector
    from paircraft.operators.split import group_split
    p = group_split(fx.vector_pairs(spark, sf))
    d = p.select("pair_id", "split", F.col("is_duplicate").cast("double").alias("label"),
                 array_to_vector(pair_vector("u", "v", two_part=True)).alias("features"))
    train = d.where(F.col("split") == "train")
    n = train.agg(F.count(F.lit(1))).first()[0]
    m = LogisticRegression(regParam=1.0 / max(n, 1), maxIter=1000, standardization=False).fit(train)
    return m.transform(d).select("pair_id", "split", vector_to_array("probability")[1].alias("p"))


@register("svd_projection")
def svd_projection(spark, sf):
    """Truncated (uncentred) SVD of the stored vectors to 10 components (M3)."""
    from paircraft.operators.experts import svd_projection as svd
    e = table_embeddings(spark, sf)
    out, _ = svd(e, "vec", 10)
    return out.select("vec_id", "svd")


def table_embeddings(spark, sf):
    from paircraft.sources.tables import table
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@register("clean_text")
def clean_text(spark, sf):
    """Cleaned and Porter-stemmed question text with its length and word
    count (X7, X9): stems computed once per distinct token."""
    from paircraft.operators.stemming import question_meta
    return question_meta(fx.pair_questions(spark, sf))


@register("refit_top_subsets")
def refit_top_subsets(spark, sf):
    """The ten (subset, rate) gates of lowest validation loss, fitted again on
    train + valid for their best number of epochs, and their test loss (G6,
    U2, T2)."""
    from paircraft.operators.metrics import binary_metrics
    train, valid, test = _split_matrix(spark, sf)
    top = sorted(_search(spark, sf), key=lambda f: (f.best, gate.subset_key(NAMES, f.members), f.lr))[:10]
    again = gate.fit_many(train.unionByName(valid), NAMES, "y", [(f.members, f.lr) for f in top], min_delta=0.0,
                          epochs=[f.best_epoch + 1 for f in top], patience=201, lr_patience=None)
    # the ten blends are columns of one table, measured in one aggregation
    scored = test.select("y", *NAMES)
    for rank, g in enumerate(again, start=1):
        members, at = [NAMES[i] for i in g.members], np.ix_(g.members, g.members)
        scored = gate.predict(scored, members, g.W[at], g.b[list(g.members)], f"p{rank}")
    each = ", ".join(f"{k}, p{k}" for k in range(1, len(again) + 1))
    long = scored.selectExpr("y", f"stack({len(again)}, {each}) as (rank, p)")
    losses = {r["rank"]: float(r["log_loss"]) for r in binary_metrics(long, "p", "y", ["rank"]).collect()}
    out = [(gate.subset_key(NAMES, f.members), f.lr, f.best_epoch, k, losses.get(k, float("nan"))) for k, f in enumerate(top, start=1)]
    return spark.createDataFrame(out, "subset string, lr double, best_epoch int, rank int, test_log_loss double")


@register("gate_fit_minibatch")
def gate_fit_minibatch(spark, sf):
    """Adam by mini-batches of 1024 on the training scores, tasks merged by
    weighted averaging after each epoch, early stop on validation (G2, P5)."""
    train, valid, _ = _split_matrix(spark, sf)
    fitted = gate.fit_minibatch(train, NAMES, "y", lr=0.05, epochs=30, valid=valid)
    rows = [("W", i, j, float(fitted.W[i][j])) for i in range(K) for j in range(K)]
    rows += [("b", i, 0, float(fitted.b[i])) for i in range(K)]
    return spark.createDataFrame(rows, "param string, i int, j int, value double")
