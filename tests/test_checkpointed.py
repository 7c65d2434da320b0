"""Checkpoints let go of the shuffle files that made them."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from paircraft.session import CLEANUP, checkpointed, staged
from paircraft.sources import fixtures as fx


def shuffled(spark) -> set:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left(spark, before: set) -> set:
    for _ in range(50):
        if not (new := shuffled(spark) - before):
            break
        time.sleep(0.2)
    return new


def test_checkpoint_lets_go_of_its_shuffle(spark):
    before, was = shuffled(spark), spark.conf.get(CLEANUP, "false")
    df = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    got = checkpointed(df)
    assert not left(spark, before)
    assert spark.conf.get(CLEANUP, "false") == was
    # what was written stays, and the table it was made of can be used again
    assert got.agg(F.sum("n")).first()[0] == df.agg(F.sum("n")).first()[0] == 5000


def test_eda_table_leaves_no_shuffle_of_texts(spark, tmp_path):
    rows = [(i, f"alpha beta {'gamma ' * (i % 3)} w{i % 5}", "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    made = fx.materialize(spark, "texts_alone", str(tmp_path), lambda: fx.table(spark, str(tmp_path), "documents").groupBy("text").agg(F.first("doc_id")))
    assert not left(spark, before)
    assert made.count() == len({r[1] for r in rows})


def test_staged_rows_are_there_for_a_while(spark):
    before, was = shuffled(spark), spark.conf.get(CLEANUP, "false")
    files = lambda: {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("staged-*")}
    there = files()
    with staged(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))) as got:
        assert not left(spark, before) and len(files() - there) == 1
        assert got.count() == 7 and got.agg(F.sum("n")).first()[0] == 5000
    assert files() == there and spark.conf.get(CLEANUP, "false") == was


def test_eda_numbers_keep_no_texts(spark, tmp_path):
    """The texts are let go when the numbers are made; texts that are there already are used and stay."""
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s")]
    made = []
    for name in ("alone", "known"):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
        if name == "known":
            fx.pair_texts(spark, sf)
        made.append(sorted(map(tuple, fx.eda_pairs(spark, sf).collect())))
        assert any(k[1:3] == ("pair_texts", sf) for k in fx._MEMO) == (name == "known")
    assert made[0] == made[1] and len(made[0]) >= 11
    assert not list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("staged-*"))
