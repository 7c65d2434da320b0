"""Registered dense-vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paircraft.functions.similarity import cosine, pair_vector
from paircraft.operators import knn
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.sources import fixtures as fx
from paircraft.sources.tables import table

R = O.R
VP = O.with_(O.VECTOR_PAIRS)

_DOT = "list_sum(list_transform(range(1, len(u) + 1), lambda i: CAST(u[i] AS DOUBLE) * CAST(v[i] AS DOUBLE)))"
_NU = "sqrt(list_sum(list_transform(u, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_NV = "sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@register("embedding_cosine", VP + f"""
SELECT pair_id, {R(f'CASE WHEN {_NU} * {_NV} = 0 THEN 0.0 ELSE {_DOT} / ({_NU} * {_NV}) END')} AS cosine
FROM vector_pairs""")
def embedding_cosine(spark, sf):
    """Cosine of the two stored vectors of each pair."""
    p = fx.vector_pairs(spark, sf)
    return p.select("pair_id", cosine("u", "v").alias("cosine"))


_PV = ("list_concat(list_concat(list_transform(u, lambda x: CAST(x AS DOUBLE)), list_transform(v, lambda x: CAST(x AS DOUBLE))), "
       "list_concat(list_transform(range(1, len(u) + 1), lambda i: abs(CAST(u[i] AS DOUBLE) - CAST(v[i] AS DOUBLE))), "
       "list_transform(range(1, len(u) + 1), lambda i: CAST(u[i] AS DOUBLE) * CAST(v[i] AS DOUBLE))))")
_PV2 = ("list_concat(list_transform(range(1, len(u) + 1), lambda i: abs(CAST(u[i] AS DOUBLE) - CAST(v[i] AS DOUBLE))), "
        "list_transform(range(1, len(u) + 1), lambda i: CAST(u[i] AS DOUBLE) * CAST(v[i] AS DOUBLE)))")


@register("pair_vectors", VP + f"""
SELECT pair_id, list_transform({_PV}, lambda x: {R('x')}) AS vec FROM vector_pairs""")
def pair_vectors(spark, sf):
    """[u, v, |u-v|, u*v] of each pair."""
    p = fx.vector_pairs(spark, sf)
    return p.select("pair_id", pair_vector("u", "v").alias("vec"))


def _dist_sql(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)))))")


@register("knn_join", f"""
WITH _d AS (SELECT a.vec_id AS qid, b.vec_id AS nid, {_dist_sql('a.embedding', 'b.embedding')} AS dist
            FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
_r AS (SELECT qid, nid, dist, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), nid) AS rank FROM _d)
SELECT qid, nid, {R('dist')} AS dist, rank FROM _r WHERE rank <= 10""")
def knn_join(spark, sf):
    """Exact 10 nearest neighbours of every stored vector among the others."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return knn.knn_join(e, e, k=10).select("qid", "nid", "dist", F.col("rank").cast("long").alias("rank"))


@register("knn_vote", VP + f""",
_pv AS (SELECT qid1 AS id, is_duplicate AS y, {_PV2} AS vec FROM vector_pairs),
_d AS (SELECT a.id AS qid, b.id AS nid, b.y AS ny, {_dist_sql('a.vec', 'b.vec')} AS dist FROM _pv a, _pv b WHERE a.id <> b.id),
_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), nid) AS rank FROM _d),
_g AS (SELECT qid, sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN dist = 0 THEN ny ELSE 0 END) AS y0,
              sum(CASE WHEN dist > 0 THEN ny / dist END) AS wy, sum(CASE WHEN dist > 0 THEN 1.0 / dist END) AS w
       FROM _r WHERE rank <= 10 GROUP BY qid)
SELECT qid, {R('CASE WHEN n0 > 0 THEN y0 / n0 ELSE wy / w END')} AS score FROM _g""")
def knn_vote(spark, sf):
    """Leave-one-out 10-NN vote weighted by 1/distance over the two-part pair
    vectors [|u-v|, u*v] (M9)."""
    p = fx.vector_pairs(spark, sf).select(F.col("qid1").alias("id"), F.col("is_duplicate").alias("y"),
                                           pair_vector("u", "v", two_part=True).alias("vec"))
    neigh = knn.knn_join(p, p, k=10)
    return knn.knn_vote(neigh, p)


@register("k95_components", f"""
WITH _e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
_v AS (SELECT i, var_samp(CAST(x AS DOUBLE)) AS var FROM _e GROUP BY i),
_c AS (SELECT i, var, sum(var) OVER (ORDER BY var DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(var) OVER () AS cum,
              row_number() OVER (ORDER BY var DESC, i) AS pos FROM _v)
SELECT min(pos) AS k95, {R('min(cum)')} AS cum_at_k FROM _c WHERE cum >= 0.95""")
def k95_components(spark, sf):
    """Smallest number of dimensions (largest variance first) whose
    cumulative share of variance reaches 95% (W2). The variance table has
    one row per dimension, so the cumulative window is tiny."""
    e = table(spark, sf, "embeddings")
    long = e.select(F.posexplode("embedding").alias("i", "x")).select((F.col("i") + 1).alias("i"), "x")
    v = long.groupBy("i").agg(F.var_samp(F.col("x").cast("double")).alias("var"))
    w = Window.orderBy(F.col("var").desc(), "i")
    c = v.select("i", "var", (F.sum("var").over(w.rowsBetween(Window.unboundedPreceding, 0)) /
                              F.sum("var").over(Window.partitionBy())).alias("cum"),
                 F.row_number().over(w).alias("pos"))
    return c.where(F.col("cum") >= 0.95).agg(F.min("pos").cast("bigint").alias("k95"), F.min("cum").alias("cum_at_k"))
