"""Distributed ordered operators that never put a whole group in one task.

A global ``Window.orderBy`` (no partition) runs in a single task, and a window
partitioned by a hot key puts that key's rows in one task. The helpers here
range-partition by (group, order key) instead, compute running sums inside
each range partition, and add the totals of the preceding partitions from a
small per-partition table (at most ``partitions x groups`` rows).

* ``ordered_cumsum``   running sums of count columns in value order
* ``value_counts``     distinct values with counts (partial aggregation)
* ``exact_quantiles``  exact linear-interpolated quantiles (``percentile``)
* ``average_ranks``    average rank with ties (for Spearman)
* ``next_in_group``    ``lead(order_col)`` within a group, skew-proof
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paircraft.session import ensure_checkpoint_dir, shuffle_partitions


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null (group keys may be null)."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_rk_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "_x",
                 extra: dict | None = None) -> DataFrame:
    """(by..., name, cnt[, extra sums]) over the non-null values of ``col``."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    for k, e in (extra or {}).items():
        aggs.append(F.sum(e).alias(k))
    return (df.where(F.col(col).isNotNull())
              .groupBy(*by, F.col(col).cast("double").alias(name)).agg(*aggs))


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   by: Sequence[str] = (), descending: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of ``c`` in ``order_col`` order
    within ``by`` groups. ``order_col`` must be unique within a group (use it
    on value-count tables)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or shuffle_partitions(spark)
    okey = F.col(order_col).desc() if descending else F.col(order_col).asc()
    # Range bounds come from a sample whose rows depend on shuffle fetch
    # order; the partition ids are read twice below (running sums, partition
    # totals), so they are fixed once with a reliable checkpoint.
    part = (df.repartitionByRange(n, *[F.col(b) for b in by], okey)
              .withColumn("_pid", F.spark_partition_id())).checkpoint()
    w_local = (Window.partitionBy("_pid", *by).orderBy(okey)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = part.select("*", *[F.sum(c).over(w_local).alias(f"_lc_{c}") for c in sum_cols])
    tot = part.groupBy("_pid", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*by).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select("_pid", *by, *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0))
                                    .alias(f"_o_{c}") for c in sum_cols])
    # The offset table has at most (partitions x groups) rows; without groups
    # it is bounded by the partition count and is broadcast.
    if not by:
        off = F.broadcast(off)
    out = join_null_safe(local, off, ["_pid", *by])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_lc_{c}")).alias(f"cum_{c}")
                                     for c in sum_cols])


def _group_totals(vc: DataFrame, by: Sequence[str]) -> DataFrame:
    return vc.groupBy(*by).agg(F.sum("cnt").alias("_n"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between closest ranks, the
    definition of Spark ``percentile`` / ``quantile_cont``.

    Returns (by..., q_idx int, prob double, value double). Work: one partial
    aggregation to distinct values, one range-partitioned running count, then
    only the <= 2 x len(probs) rows per group that hold a target rank.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return quantiles_from_counts(value_counts(df, col, by).checkpoint(), probs, by)


def quantiles_from_counts(vc: DataFrame, probs: Sequence[float],
                          by: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` over a value-count table (by..., _x, cnt)."""
    cum = ordered_cumsum(vc.select(*by, "_x", "cnt"), "_x", ["cnt"], by)
    if by:
        tot = _group_totals(vc, by)
        cum = join_null_safe(cum, tot, list(by))
    else:
        # scalar subquery, projected before use (not allowed inside lambdas)
        cum = cum.select("*", vc.agg(F.sum("cnt")).scalar().alias("_n"))
    n = F.col("_n")
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    idx = F.sequence(F.lit(0), F.lit(len(probs) - 1))
    lo_rank = lambda p: F.floor((n - 1) * p)
    hi_rank = lambda p: F.ceil((n - 1) * p)
    first = F.col("cum_cnt") - F.col("cnt")
    last = F.col("cum_cnt") - 1
    # For each prob: does this distinct value hold the low or the high rank?
    hits = F.filter(
        F.transform(idx, lambda i: F.struct(
            i.alias("q_idx"),
            ((lo_rank(probs_arr[i]) >= first) & (lo_rank(probs_arr[i]) <= last)).alias("is_lo"),
            ((hi_rank(probs_arr[i]) >= first) & (hi_rank(probs_arr[i]) <= last)).alias("is_hi"))),
        lambda s: s["is_lo"] | s["is_hi"])
    ex = cum.select(*by, "_x", "_n", F.explode(hits).alias("h"))
    g = ex.groupBy(*by, F.col("h.q_idx").alias("q_idx")).agg(
        F.max(F.when(F.col("h.is_lo"), F.col("_x"))).alias("_lo"),
        F.max(F.when(F.col("h.is_hi"), F.col("_x"))).alias("_hi"),
        F.first("_n").alias("_n"))
    p = probs_arr[F.col("q_idx")]
    pos = (F.col("_n") - 1) * p
    frac = pos - F.floor(pos)
    val = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac
    return g.select(*by, F.col("q_idx").cast("int").alias("q_idx"), p.alias("prob"),
                    F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(val).alias("value"))


def quantile_edges(df: DataFrame, col: str, q: int, by: Sequence[str] = (),
                   counts: DataFrame | None = None) -> DataFrame:
    """(by..., edges array<double>) = distinct quantile edges at 0, 1/q, ..., 1
    (``qcut(..., duplicates='drop')`` edges). One small row per group.
    ``counts`` may pass a ready value-count table of ``col``."""
    probs = [i / q for i in range(q + 1)]
    vc = counts if counts is not None else value_counts(df, col, by).checkpoint()
    qs = quantiles_from_counts(vc, probs, by)
    return qs.groupBy(*by).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "value"))),
                                     lambda s: s["value"])).alias("edges"))


def average_ranks(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """(by..., _x, <name>) = average 1-based rank of each distinct value with
    ties (W3); join back on the value to rank rows."""
    ensure_checkpoint_dir(df.sparkSession)
    vc = value_counts(df, col, by).checkpoint()
    cum = ordered_cumsum(vc, "_x", ["cnt"], by)
    return cum.select(*by, "_x",
                      (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias(name))


def next_in_group(df: DataFrame, group_cols: Sequence[str], order_col: str,
                  out: str = "next", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = ``lead(order_col) over (partition by group order by order_col)``
    without placing a whole group in one task. ``order_col`` must be unique
    within a group. Rows are range-partitioned by (group, order_col); the
    lead inside a partition is a local window; the last row of each partition
    takes the first value of the next partition that has the same group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or shuffle_partitions(spark)
    keys = [F.col(g) for g in group_cols] + [F.col(order_col)]
    part = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_pid", *group_cols).orderBy(order_col)
    local = part.withColumn("_lead", F.lead(order_col).over(w))
    firsts = part.groupBy("_pid", *group_cols).agg(F.min(order_col).alias("_first"))
    wf = Window.partitionBy(*group_cols).orderBy("_pid")
    nxt = firsts.select("_pid", *group_cols, F.lead("_first").over(wf).alias("_next_first"))
    res = join_null_safe(local, nxt, ["_pid", *group_cols], "left")
    return res.select(*df.columns, F.coalesce("_lead", "_next_first").alias(out))
