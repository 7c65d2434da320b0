"""Readers for the input tables (parquet) and the pair CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from paircraft.schema import PAIR

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; parquet keeps pushdown and column pruning."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pair CSV with a declared schema; quoted fields may span lines."""
    return (spark.read.schema(PAIR).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def write_pairs_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = (df.write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink; ``partition_by`` (e.g. ``split``) enables partition pruning
    on read (S2, S3, S4)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """Small result tables (summaries, grids) as one CSV file (S7). Only for
    results whose size is bounded by parameters, never row data."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
