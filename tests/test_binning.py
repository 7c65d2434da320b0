from pyspark.sql import functions as F

from paircraft.functions.binning import fixed_bin
from paircraft.operators import eda


def test_fixed_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.0001,), (50.0,), (51.0,), (None,)], "x double")
    got = [r[0] for r in df.select(fixed_bin("x")).collect()]
    assert got == [0, 0, 1, 8, 9, 0]


def test_quantile_bins_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 1)], "x double, y int")
    out = eda.dup_rate_by_quantile(df, "x", 10, "y").collect()
    assert len(out) == 1 and out[0].n == 3 and out[0].n_dup == 2


def test_quantile_bins_ties_and_few_values(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in [1, 1, 1, 2, 3]], "x double, y int")
    out = sorted(eda.dup_rate_by_quantile(df, "x", 10, "y").collect(), key=lambda r: r.bin)
    assert sum(r.n for r in out) == 5
    assert out[0].lo == 1.0
