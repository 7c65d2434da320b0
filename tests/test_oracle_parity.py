"""A few registered queries against their DuckDB oracle on the smallest
tables (the full comparison is tools/oracle_check.py)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from paircraft.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["jaccard", "dup_rate_by_jaccard", "roc_auc", "group_split", "benchmark_leaderboard",
         "parse_metric_log", "knn_join", "tfidf_word_cosine", "numeric_block"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)
