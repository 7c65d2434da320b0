"""Registered evaluation and benchmark-table queries (E1-E4, A14-A16, T1,
T2, F5, F7, F8, U3, S6, S11, X24-X26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircraft.operators import eda, metrics
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.plans.q_text import _NN, _tfidf_ctes
from paircraft.sources import fixtures as fx
from paircraft.sources import metric_log

R = O.R


def round6(c: str):
    """Same IEEE rounding as the SQL side, so formatting never sees a tie."""
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < 1e12, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x)

# ---------------------------------------------------------------- score fixtures (SQL)
SCORES = _tfidf_ctes("word") + f""",
_pk AS (SELECT pair_id, is_duplicate AS y, md5(question1) AS k1, md5(question2) AS k2,
               {O.jaccard_set('question1')} AS s1, {O.jaccard_set('question2')} AS s2 FROM doc_pairs {_NN}),
_pa AS MATERIALIZED (SELECT p.pair_id, p.k2, a.term, a.w FROM _pk p JOIN _w a ON a.qkey = p.k1),
_dot AS (SELECT pa.pair_id, sum(pa.w * b.w) AS dot FROM _pa pa JOIN _w b ON b.qkey = pa.k2 AND b.term = pa.term
         GROUP BY pa.pair_id),
_sc AS (
  SELECT pair_id, 'containment' AS expert, {O.set_containment('s1', 's2')} AS p, y FROM _pk
  UNION ALL SELECT pair_id, 'jaccard', {O.set_jaccard('s1', 's2')}, y FROM _pk
  UNION ALL SELECT p.pair_id, 'tfidf_cosine', coalesce(d.dot, 0.0), p.y FROM _pk p LEFT JOIN _dot d USING (pair_id)),
scores AS (SELECT pair_id, expert, floor(p * 1000000000.0 + 0.5) / 1000000000.0 AS p, y FROM _sc)"""

EV = O.with_(O.EVENT_SCORES)
RUNS = O.with_(O.RUNS)


def _metrics_sql(src: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    pc = "least(greatest(CAST(p AS DOUBLE), 1.1920929e-07), 1 - 1.1920929e-07)"
    return f"""
, _m AS (SELECT {g}count(*) AS n,
         avg(-(y * ln({pc}) + (1 - y) * ln(1 - {pc}))) AS log_loss,
         sum(CASE WHEN p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN p <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p <= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS tn
         FROM {src} WHERE p IS NOT NULL AND y IS NOT NULL {'GROUP BY ' + by if by else ''})
SELECT {g}n, {R('log_loss')} AS log_loss, {R('(tp + tn) / n')} AS accuracy,
       {R('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS precision,
       {R('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS recall,
       {R('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1 FROM _m"""


def _auc_sql(src: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
, _v AS (SELECT {g}CAST(p AS DOUBLE) AS x, sum(y) AS pos, sum(1 - y) AS neg FROM {src}
         WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY {g}x),
_c AS (SELECT {g}pos, neg, sum(neg) OVER ({part}ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS nb FROM _v),
_a AS (SELECT {g}CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 'NaN'::DOUBLE
              ELSE sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc FROM _c {'GROUP BY ' + by if by else ''})"""


@register("binary_metrics", EV + _metrics_sql("event_scores"))
def binary_metrics(spark, sf):
    """Log-loss, accuracy, precision, recall, F1 of a tied score."""
    return metrics.binary_metrics(fx.event_scores(spark, sf))


@register("roc_auc", EV + _auc_sql("event_scores") + f"\nSELECT {R('auc')} AS auc FROM _a")
def roc_auc(spark, sf):
    """Exact ROC-AUC with heavy ties."""
    return metrics.roc_auc(fx.event_scores(spark, sf))


def _model_metrics_sql() -> str:
    m = _metrics_sql("scores", "expert")
    m = m.replace("SELECT expert, n,", "SELECT _m.expert, n,").replace(
        "AS f1 FROM _m", f"AS f1, {R('auc')} AS auc FROM _m JOIN _a USING (expert)")
    return SCORES + _auc_sql("scores", "expert") + m


@register("model_metrics", _model_metrics_sql())
def model_metrics(spark, sf):
    """All metrics of every expert in one pass over the long score table."""
    return metrics.model_metrics(fx.scores(spark, sf))


@register("prediction_matrix", SCORES + """
SELECT pair_id, """ + ", ".join(f"{R(f'max(CASE WHEN expert = {O.lit(e)} THEN p END)')} AS {e}"
                                for e in fx.SCORE_EXPERTS) + """, max(y) AS y FROM scores GROUP BY pair_id""")
def prediction_matrix(spark, sf):
    """Wide pair x expert score matrix from the long cache."""
    s = fx.scores(spark, sf)
    return s.groupBy("pair_id").pivot("expert", list(fx.SCORE_EXPERTS)).agg(F.max("p")) \
            .join(s.groupBy("pair_id").agg(F.max("y").alias("y")), "pair_id")


@register("stale_predictions", O.with_(O.DOC_PAIRS_NULL) + f""",
_all AS (SELECT pair_id, 'full' AS expert FROM doc_pairs WHERE question1 IS NOT NULL AND question2 IS NOT NULL
         UNION ALL SELECT pair_id, 'partial' FROM doc_pairs_null WHERE question1 IS NOT NULL AND question2 IS NOT NULL),
_exp AS (SELECT count(*) AS n_expected FROM doc_pairs WHERE question1 IS NOT NULL AND question2 IS NOT NULL)
SELECT expert, count(*) AS n_rows, any_value(n_expected) AS n_expected, count(*) <> any_value(n_expected) AS stale
FROM _all, _exp GROUP BY expert""")
def stale_predictions(spark, sf):
    """Cached score columns whose row count differs from the split."""
    full = fx.doc_pairs(spark, sf).dropna(subset=["question1", "question2"])
    part = fx.doc_pairs_null(spark, sf).dropna(subset=["question1", "question2"])
    cache = full.select("pair_id", F.lit("full").alias("expert")).unionByName(
        part.select("pair_id", F.lit("partial").alias("expert")))
    n = full.agg(F.count(F.lit(1))).scalar()
    return cache.groupBy("expert").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "expert", "n_rows", n.alias("n_expected"), (F.col("n_rows") != n).alias("stale"))


@register("drop_null_pairs", O.with_(O.DOC_PAIRS_NULL) + """
SELECT pair_id, qid1, qid2, is_duplicate FROM doc_pairs_null WHERE question1 IS NOT NULL AND question2 IS NOT NULL""")
def drop_null_pairs(spark, sf):
    """Rows with a null text are dropped (F1)."""
    from paircraft.operators.tables import drop_null_pairs as dn
    return dn(fx.doc_pairs_null(spark, sf)).select("pair_id", "qid1", "qid2", "is_duplicate")


@register("class_weights", """
WITH _c AS (SELECT quality, count(*) AS n_c FROM documents d JOIN labels l USING (doc_id) GROUP BY quality),
_n AS (SELECT sum(n_c) AS n FROM _c)
SELECT quality, n_c, """ + R("n / (2.0 * n_c)") + """ AS weight FROM _c, _n""")
def class_weights(spark, sf):
    """Balanced class weights n / (2 n_c) (M6)."""
    d = fx.doc_labels(spark, sf)
    c = d.groupBy("quality").agg(F.count(F.lit(1)).alias("n_c"))
    n = d.agg(F.count(F.lit(1))).scalar()
    return c.select("quality", "n_c", (n / (2.0 * F.col("n_c"))).alias("weight"))


# ---------------------------------------------------------------- benchmark tables
_M = ["seconds", "test_LL", "test_ACC", "test_F1"]


@register("metric_describe", RUNS + ",\n_l AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM runs" for m in _M) + f""")
SELECT metric, count(value) AS count, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std,
       {R('quantile_cont(value, 0.0)')} AS min, {R('quantile_cont(value, 0.25)')} AS p25,
       {R('quantile_cont(value, 0.5)')} AS p50, {R('quantile_cont(value, 0.75)')} AS p75,
       {R('quantile_cont(value, 1.0)')} AS max FROM _l GROUP BY metric""")
def metric_describe(spark, sf):
    """count, mean, std, min, quartiles, max of each benchmark metric."""
    return eda.describe(fx.runs(spark, sf), _M)


def _rank_sql(col: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"


_RK = RUNS + ",\n_r AS (SELECT run_id, " + ", ".join(
    f"{_rank_sql(c)} AS {c}" for c in _M + ["lr", "epochs"]) + " FROM runs)"


@register("spearman_matrix", _RK + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS rho FROM _r"
    for i, a in enumerate(_M) for j, b in enumerate(_M) if j < i) + ")")
def spearman_matrix(spark, sf):
    """Spearman rank correlation of the metrics, lower triangle."""
    return metrics.spearman_matrix(fx.runs(spark, sf), "run_id", _M)


@register("spearman_vs_config", _RK + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {R(f'corr({m}, lr)')} AS rho_lr, {R(f'corr({m}, epochs)')} AS rho_epochs FROM _r"
    for m in _M) + ")")
def spearman_vs_config(spark, sf):
    """Spearman correlation of each metric with learning rate and epochs."""
    cols = _M + ["lr", "epochs"]
    r = metrics.rank_columns(fx.runs(spark, sf), "run_id", cols)
    row = r.agg(*[F.corr(m, c).alias(f"{m}__{c}") for m in _M for c in ("lr", "epochs")])
    stack = ", ".join(f"'{m}', `{m}__lr`, `{m}__epochs`" for m in _M)
    return row.selectExpr(f"stack({len(_M)}, {stack}) as (metric, rho_lr, rho_epochs)")


@register("benchmark_leaderboard", RUNS + f"""
SELECT run_id, model, {R('test_LL')} AS test_LL, {R('test_ACC')} AS test_ACC, {R('test_F1')} AS test_F1,
       row_number() OVER (ORDER BY test_LL, test_ACC DESC, test_F1 DESC, run_id) AS rank FROM runs""")
def benchmark_leaderboard(spark, sf):
    """Runs ordered by log-loss asc, accuracy desc, F1 desc, numbered."""
    r = fx.runs(spark, sf).select("run_id", "model", "test_LL", "test_ACC", "test_F1")
    return metrics.leaderboard(r)


@register("benchmark_pretty", RUNS + f"""
SELECT run_id, array_to_string(list_transform(string_split(model, '+'), lambda p: upper(substring(p, 1, 2))), '+') AS model,
       array_to_string(list_transform(string_split(model, '+'), lambda p: upper(substring(p, 1, 1))), '+') AS short,
       printf('%.2f', seconds) AS seconds, printf('%.6f', {R('test_LL')}) AS test_LL,
       printf('%.6f', {R('test_ACC')}) AS test_ACC, printf('%.6f', {R('test_F1')}) AS test_F1 FROM runs""")
def benchmark_pretty(spark, sf):
    """Selected, renamed, fixed-precision columns and abbreviated member names
    (F7, F8)."""
    r = fx.runs(spark, sf)
    return r.select("run_id", metrics.abbreviate("model", 2).alias("model"), metrics.abbreviate("model", 1).alias("short"),
                    F.format_string("%.2f", "seconds").alias("seconds"),
                    *[F.format_string("%.6f", round6(c)).alias(c) for c in ("test_LL", "test_ACC", "test_F1")])


@register("benchmark_union", RUNS + """
SELECT run_id, model, ROUNDSEC AS seconds, CAST(0.001 AS DOUBLE) AS lr_cfg, 1 AS epochs_cfg FROM runs WHERE lr = 0.001
UNION ALL SELECT run_id, model, ROUNDSEC, CAST(0.01 AS DOUBLE), 2 FROM runs WHERE lr = 0.01
UNION ALL SELECT run_id, model, ROUNDSEC, CAST(0.05 AS DOUBLE), 10 FROM runs WHERE lr = 0.05""".replace("ROUNDSEC", R("seconds")))
def benchmark_union(spark, sf):
    """Three benchmark tables, each tagged with its config, unioned."""
    r = fx.runs(spark, sf)
    parts = [r.where(F.col("lr") == lr).select("run_id", "model", "seconds", F.lit(lr).alias("lr_cfg"),
                                                F.lit(ep).alias("epochs_cfg"))
             for lr, ep in ((0.001, 1), (0.01, 2), (0.05, 10))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("parse_metric_log", O.with_(O.RUNS, metric_log.LOG_LINES_SQL) + metric_log.PARSE_SQL)
def parse_metric_log(spark, sf):
    """Parse log lines with commas inside values and glued records."""
    lines = metric_log.log_lines(fx.runs(spark, sf))
    return metric_log.parse_log(lines).select("ts", "caller", "pid", "model", "lr", "seconds", "note")


@register("pending_runs", O.with_(O.RUNS, metric_log.LOG_LINES_SQL) + metric_log.PARSE_SQL_CTE + """
SELECT r.run_id, r.model, r.lr FROM runs r
WHERE NOT EXISTS (SELECT 1 FROM _parsed p WHERE p.model = r.model AND p.lr = printf('%.3f', r.lr) AND p.pid = CAST(r.run_id AS VARCHAR))""")
def pending_runs(spark, sf):
    """Runs not yet in the log: left anti join on the logged keys."""
    r = fx.runs(spark, sf)
    done = metric_log.parse_log(metric_log.log_lines(r)).select("pid", "model", "lr")
    keyed = r.select("run_id", "model", "lr", F.col("run_id").cast("string").alias("pid"),
                     F.format_string("%.3f", "lr").alias("lr_s"))
    return keyed.join(done.withColumnRenamed("lr", "lr_s"), ["pid", "model", "lr_s"], "left_anti") \
                .select("run_id", "model", "lr")


@register("parse_run_key", RUNS + """,
_k AS (SELECT run_id, concat('gate_', model, '_lr', printf('%.3f', lr), '_ep', epochs, '.pt') AS key FROM runs),
_s AS (SELECT run_id, key, regexp_replace(regexp_replace(key, '^gate_', ''), '[.]pt$', '') AS core FROM _k)
SELECT run_id, key, regexp_extract(core, '^(.*)_lr', 1) AS model,
       CAST(regexp_extract(core, '_lr([0-9.]+)_ep', 1) AS DOUBLE) AS lr,
       CAST(regexp_extract(core, '_ep([0-9]+)$', 1) AS INTEGER) AS epochs,
       len(string_split(regexp_extract(core, '^(.*)_lr', 1), '+')) AS n_members FROM _s""")
def parse_run_key(spark, sf):
    """Build run keys like file names and parse model, lr, epochs back."""
    r = fx.runs(spark, sf)
    k = r.select("run_id", F.concat(F.lit("gate_"), "model", F.lit("_lr"), F.format_string("%.3f", "lr"),
                                    F.lit("_ep"), F.col("epochs").cast("string"), F.lit(".pt")).alias("key"))
    core = F.regexp_replace(F.regexp_replace("key", "^gate_", ""), "[.]pt$", "")
    k = k.withColumn("core", core)
    model = F.regexp_extract("core", "^(.*)_lr", 1)
    return k.select("run_id", "key", model.alias("model"),
                    F.regexp_extract("core", "_lr([0-9.]+)_ep", 1).cast("double").alias("lr"),
                    F.regexp_extract("core", "_ep([0-9]+)$", 1).cast("int").alias("epochs"),
                    F.size(F.split(model, r"\+")).cast("bigint").alias("n_members"))


@register("content_fingerprint", RUNS + """,
_h AS (SELECT run_id, substr(sha1(model), 1, 8) AS name_hash,
              ('0x' || substr(sha1(concat_ws('|', CAST(run_id AS VARCHAR), model, printf('%.2f', seconds))), 1, 15))::BIGINT AS rh
       FROM runs)
SELECT 'row' AS kind, CAST(run_id AS VARCHAR) AS k, name_hash AS v FROM _h
UNION ALL SELECT 'table', 'all', concat(count(*), ':', sum(rh) % 1000000007) FROM _h""")
def content_fingerprint(spark, sf):
    """Short name hash per run and an order-free fingerprint of the whole
    table from per-row hashes summed in a distributed aggregation (X24)."""
    r = fx.runs(spark, sf)
    rh = F.conv(F.substring(F.sha1(F.concat_ws("|", F.col("run_id").cast("string"), "model",
                                                F.format_string("%.2f", "seconds"))), 1, 15), 16, 10).cast("bigint")
    h = r.select("run_id", F.substring(F.sha1("model"), 1, 8).alias("name_hash"), rh.alias("rh"))
    rows = h.select(F.lit("row").alias("kind"), F.col("run_id").cast("string").alias("k"), F.col("name_hash").alias("v"))
    tab = h.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"),
                         (F.sum(F.col("rh").cast("decimal(38,0)")) % 1000000007).cast("bigint").cast("string")).alias("v")) \
           .select(F.lit("table").alias("kind"), F.lit("all").alias("k"), "v")
    return rows.unionByName(tab)
