"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operator has a plain-SQL form, the DuckDB oracle SQL.

Query modules register themselves on import (``paircraft.plans.q_*``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns (and arrays of doubles) so that results of
    different summation orders compare equal."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    scale = float(10 ** digits)

    def rnd(x):
        # floor(x * 1e6 + 0.5) / 1e6: plain IEEE arithmetic, so every engine
        # gives the same result (decimal HALF_UP rounding differs between
        # engines on values like 0.0640625); NaN and huge values pass through
        x = x.cast("double")
        return F.when(F.abs(x) < 1e12, F.floor(x * scale + 0.5) / scale).otherwise(x)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rnd(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
                f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, rnd)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL.
    Double outputs are rounded to 6 decimals (the SQL side does the same)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from paircraft.plans import (q_eda, q_io, q_metrics, q_models, q_scores, q_sources,  # noqa: F401
                                 q_text, q_vectors)
