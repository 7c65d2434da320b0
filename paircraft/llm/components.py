"""Connected components of an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _to_minimum(pairs: DataFrame, up: bool) -> DataFrame:
    """Each u's neighbours v (above u only, if ``up``) joined to the smallest of
    u and its neighbours. Hot u: the minimum is aggregated partially, and AQE
    may split the join, as the other side has one row per u."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    both = pairs.join(least, "u")
    far = both.where(F.col("v") > F.col("u")) if up else both
    out = far.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not up:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node
    that links reach. Alternating large-star and small-star steps, each cut by
    a checkpoint, until nothing changes; no component is ever gathered."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        large = _to_minimum(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        e = cut(_to_minimum(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
