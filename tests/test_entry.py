import glob
import os
import subprocess
import sys

import pyspark

import __spark_entry__ as E
from paircraft.schema import stop_words

REPO = os.path.dirname(os.path.abspath(E.__file__))


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) == {"bin", "lo", "hi", "n", "n_dup", "dup_rate"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_registry_loads_from_zipped_pyspark():
    """A driver may put ``pyspark.zip`` on the path; the registry must load
    from it, without a session."""
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(os.path.join(lib, "*.zip"))
    env = dict(os.environ, PYTHONPATH=":".join([*zips, REPO]))
    code = ("import pyspark, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql();"
            "assert '.zip' in pyspark.__file__; assert set(o) <= set(q); print(len(q))")
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) >= 89


def test_stop_words_equal_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(stop_words()) == StopWordsRemover.loadDefaultStopWords("english")
