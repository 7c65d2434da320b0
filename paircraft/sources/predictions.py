"""Cache of expert predictions: a table partitioned by expert.

A column is computed only when its partition is missing, and a cached one is
used only when it has a row for every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, p, expert) of the cache; empty before anything is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "pair_id string, p double, expert string")
    return spark.read.schema("pair_id string, p double, expert string").parquet(path)


def missing(spark: SparkSession, path: str, experts: Sequence[str]) -> list[str]:
    """Experts without a partition, by an anti join with the wanted names."""
    wanted = spark.createDataFrame([(e,) for e in experts], "expert string")
    have = cached(spark, path).select("expert").distinct()
    return sorted(r.expert for r in wanted.join(have, "expert", "left_anti").collect())


def stale(spark: SparkSession, path: str, n_pairs: int) -> list[str]:
    """Experts whose partition has not one row per pair."""
    counts = cached(spark, path).groupBy("expert").count().where(F.col("count") != n_pairs).collect()  # a row per expert
    return sorted(r.expert for r in counts)


def complete(spark: SparkSession, path: str, pairs: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The cache with a partition per scorer. Stale and missing ones are
    computed from ``pairs`` and put in place by one write that overwrites the
    partitions it holds and no others (dynamic overwrite): the old rows stay
    readable until the new ones are there. The others are read."""
    todo = sorted(set(stale(spark, path, pairs.count())) & set(scorers) | set(missing(spark, path, list(scorers))))
    new = None
    for e in todo:
        one = scorers[e](pairs).select("pair_id", F.col("p").cast("double").alias("p"), F.lit(e).alias("expert"))
        new = one if new is None else new.unionByName(one)
    if new is not None:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expert").parquet(path)
    return cached(spark, path).where(F.col("expert").isin(list(scorers)))
