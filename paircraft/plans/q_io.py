"""Registered queries that write and read again, and the remaining small
operators (S1, S2, S5, S9, S10, P5, J3, A10, X16, X23)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paircraft.functions.similarity import l2_normalize
from paircraft.operators import eda, metrics, split, tables
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.plans.q_metrics import SCORES
from paircraft.plans.q_sources import _SPLIT
from paircraft.schema import SPLIT_SEED
from paircraft.session import ensure_checkpoint_dir
from paircraft.sources import fixtures as fx
from paircraft.sources import metric_log, predictions
from paircraft.sources.tables import read_pairs_csv as read_csv
from paircraft.sources.tables import table, write_pairs_csv, write_table

R = O.R


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("read_pairs_csv", O.with_(O.DOC_PAIRS) + """
SELECT qid1, qid2, is_duplicate, length(question1) AS n1, md5(question2) AS h2 FROM doc_pairs""")
def read_pairs_csv(spark, sf):
    """The pair table written as CSV and read with its declared schema."""
    path = _folder(spark, "pairs-csv")
    write_pairs_csv(fx.doc_pairs(spark, sf).select("qid1", "qid2", "question1", "question2", "is_duplicate"), path)
    return read_csv(spark, path).select("qid1", "qid2", "is_duplicate", F.length("question1").cast("bigint").alias("n1"),
                                        F.md5(F.col("question2").cast("binary")).alias("h2"))


@register("split_tables", _SPLIT + "\nSELECT pair_id, grp FROM _split WHERE split = 'valid'")
def split_tables(spark, sf):
    """Pairs written partitioned by split; reading one split prunes the others."""
    path = _folder(spark, "splits")
    write_table(split.group_split(fx.pair_ids(spark, sf)).select("pair_id", "grp", "split"), path, "split")
    return spark.read.parquet(path).where(F.col("split") == "valid").select("pair_id", "grp")


@register("log_append_roundtrip", O.with_(O.RUNS) + """
SELECT printf('2025-06-04 %02d:%02d:%02d', (run_id // 3600) % 24, (run_id // 60) % 60, run_id % 60) AS ts,
       'bench.py' AS caller, CAST(run_id AS VARCHAR) AS pid, model, printf('%.3f', lr) AS lr,
       concat('n', run_id % 5, ',x') AS note FROM runs""")
def log_append_roundtrip(spark, sf):
    """Metric events of every run appended to the log, in two writes, and
    parsed from its text (S5, S6)."""
    rid = F.col("run_id")
    ev = fx.runs(spark, sf).select(
        F.format_string("2025-06-04 %02d:%02d:%02d", (rid / 3600).cast("bigint") % 24, (rid / 60).cast("bigint") % 60,
                        rid % 60).alias("ts"),
        F.lit("bench.py").alias("caller"), rid.alias("pid"), "model", F.format_string("%.3f", "lr").alias("lr"),
        F.concat(F.lit("n"), (rid % 5).cast("string"), F.lit(",x")).alias("note"))
    root = _folder(spark, "log")
    for odd in (0, 1):
        metric_log.append_events(ev.where(F.col("pid") % 2 == odd), root, "benchmarks")
    return metric_log.parse_log(metric_log.read_log(spark, root)).select("ts", "caller", "pid", "model", "lr", "note")


@register("prediction_cache", SCORES + f"""
SELECT expert, count(*) AS n, {R('avg(p)')} AS mean_p FROM scores GROUP BY expert""")
def prediction_cache(spark, sf):
    """A cache with a stale and a missing expert, completed and read."""
    s = fx.scores(spark, sf)
    path = _folder(spark, "predictions")
    one = lambda e: s.where(F.col("expert") == e).select("pair_id", "p")
    first, second, _ = fx.SCORE_EXPERTS
    one(first).write.parquet(f"{path}/expert={first}")
    one(second).union(one(second)).write.parquet(f"{path}/expert={second}")  # twice the rows: stale
    pairs = s.select("pair_id").distinct()
    scorers = {e: (lambda p, e=e: p.join(one(e), "pair_id")) for e in fx.SCORE_EXPERTS}
    whole = predictions.complete(spark, path, pairs, scorers)
    return whole.groupBy("expert").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))


@register("turn_pairs", O.with_(O.TURN_PAIRS) + """
SELECT pair_id, conv_id, turn1, turn2, length(question1) AS n1, length(question2) AS n2 FROM turn_pairs""")
def turn_pairs(spark, sf):
    """A user turn and the assistant turn that follows it, as pairs."""
    n = lambda c: F.length(c).cast("bigint")
    return fx.turn_pairs(spark, sf).select("pair_id", "conv_id", "turn1", "turn2", n("question1").alias("n1"),
                                           n("question2").alias("n2"))


@register("class_counts", O.with_(O.DOC_PAIRS) + """
SELECT is_duplicate AS label, count(*) AS n FROM doc_pairs WHERE is_duplicate IS NOT NULL GROUP BY is_duplicate""")
def class_counts(spark, sf):
    """Bars of the class count plot (A10)."""
    return eda.class_counts(fx.doc_pairs(spark, sf).where(F.col("is_duplicate").isNotNull()))


@register("minibatches", _SPLIT + f"""
SELECT CAST(('0x' || substr(md5(concat(pair_id, '-', '{SPLIT_SEED + 1}')), 1, 8))::BIGINT % 8 AS INTEGER) AS batch,
       count(*) AS n, min(pair_id) AS first_pair FROM _split WHERE split = 'train' GROUP BY 1""")
def minibatches(spark, sf):
    """The training pairs dealt to eight batches of the first epoch (P5)."""
    train = split.group_split(fx.pair_ids(spark, sf)).where(F.col("split") == "train")
    return (split.with_batch(train, "pair_id", 1, 8).groupBy("batch")
            .agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("first_pair")))


@register("gathered_vectors", """
SELECT a.vec_id AS qid1, b.vec_id AS qid2, len(a.embedding) AS dim1, """ + R("a.embedding[1]") + " AS u0, " + R("b.embedding[1]") + """ AS v0
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def gathered_vectors(spark, sf):
    """Vectors of both sides of each pair by two joins on the key."""
    e = table(spark, sf, "embeddings")
    pairs = fx.vector_pairs(spark, sf).select("qid1", "qid2")
    return tables.gather_pair_vectors(pairs, e).select(
        "qid1", "qid2", F.size("u").cast("bigint").alias("dim1"), F.col("u")[0].cast("double").alias("u0"),
        F.col("v")[0].cast("double").alias("v0"))


@register("unit_vectors", f"""
SELECT vec_id, {R('embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))')} AS x0,
       {R('CAST(1 AS DOUBLE)')} AS norm FROM embeddings""")
def unit_vectors(spark, sf):
    """Vectors scaled to unit length."""
    e = table(spark, sf, "embeddings").select("vec_id", l2_normalize("embedding").alias("x"))
    return e.select("vec_id", F.col("x")[0].alias("x0"),
                    F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm"))


@register("softmax_scores", SCORES + """,
_sm AS (SELECT pair_id, """ + ", ".join(f"max(CASE WHEN expert = {O.lit(e)} THEN p END) AS {e}" for e in fx.SCORE_EXPERTS) + """
       FROM scores GROUP BY pair_id)
SELECT pair_id, """ + ", ".join(
    R(f"exp({e}) / (" + " + ".join(f"exp({x})" for x in fx.SCORE_EXPERTS) + ")") + f" AS w_{e}" for e in fx.SCORE_EXPERTS) + " FROM _sm")
def softmax_scores(spark, sf):
    """Softmax over the experts' scores of each pair."""
    names = list(fx.SCORE_EXPERTS)
    wide = fx.scores(spark, sf).groupBy("pair_id").pivot("expert", names).agg(F.max("p"))
    return wide.select("pair_id", *[w.alias(f"w_{e}") for e, w in zip(names, metrics.softmax_cols([F.col(e) for e in names]))])


# ---------------------------------------------------------------- tables written and read again
@register("question_table", O.with_(O.DOC_PAIRS) + f"""
SELECT md5(q) AS qkey, length(q) AS n_chars, {O.clean_nostem('q')} AS clean FROM
  (SELECT DISTINCT q FROM (SELECT question1 AS q FROM doc_pairs UNION ALL SELECT question2 FROM doc_pairs) WHERE q IS NOT NULL)""")
def question_table(spark, sf):
    """The question table written once and read back with its cleaned texts (S3)."""
    path = _folder(spark, "questions")
    write_table(fx.pair_questions(spark, sf), path)
    return spark.read.parquet(path).select("qkey", F.length("question").cast("bigint").alias("n_chars"), "clean")


@register("vector_table", f"""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, {R('list_sum([CAST(x AS DOUBLE) FOR x IN embedding])')} AS total FROM embeddings""")
def vector_table(spark, sf):
    """Vectors written as array<float> and read back, the label's column left
    unread (S4)."""
    path = _folder(spark, "vectors")
    write_table(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"), total.alias("total"))


@register("summary_csv", O.with_(O.DOC_PAIRS) + """
SELECT is_duplicate, count(*) AS n FROM doc_pairs WHERE is_duplicate IS NOT NULL GROUP BY is_duplicate""")
def summary_csv(spark, sf):
    """A summary written as one CSV file and read with its schema."""
    from paircraft.sources.tables import write_summary_csv
    path = _folder(spark, "summary")
    pairs = fx.doc_pairs(spark, sf).where(F.col("is_duplicate").isNotNull())
    write_summary_csv(pairs.groupBy("is_duplicate").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("is_duplicate int, n bigint").option("header", True).csv(path)


@register("conform_label", """
SELECT doc_id, CAST(toxic AS INTEGER) AS toxic FROM labels""")
def conform_label(spark, sf):
    """Labels that came as text, as 0/1 integers."""
    text = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return tables.conform_label(text, "toxic")


def _tokens_sql(q: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({q}, '\\s+'), lambda t: t <> ''))"


@register("token_set_parts", O.with_(O.DOC_PAIRS) + f""",
_t AS (SELECT pair_id, {_tokens_sql('question1')} AS a, {_tokens_sql('question2')} AS b FROM doc_pairs
       WHERE question1 IS NOT NULL AND question2 IS NOT NULL),
_n AS (SELECT pair_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS shared FROM _t)
SELECT pair_id, CAST(shared AS BIGINT) AS shared, CAST(na - shared AS BIGINT) AS only1, CAST(nb - shared AS BIGINT) AS only2 FROM _n""")
def token_set_parts(spark, sf):
    """Sizes of the common and the remaining token sets of each pair, the set
    part of the token-set ratio (X11)."""
    from paircraft.functions.similarity import token_set_parts as parts
    p = tables.drop_null_pairs(fx.doc_pairs(spark, sf))
    return p.select("pair_id", *parts("question1", "question2"))
