from pyspark.sql import functions as F

from paircraft.sources.tables import read_pairs_csv, write_pairs_csv, write_table


def test_pairs_csv_roundtrip(spark, tmp_path):
    rows = [(1, 2, 'a, "quoted"\nline', "b", 1), (3, 5, None, "", 0)]
    df = spark.createDataFrame(rows, "qid1 long, qid2 long, question1 string, question2 string, is_duplicate int")
    path = str(tmp_path / "pairs")
    write_pairs_csv(df, path)
    back = read_pairs_csv(spark, path)
    got = sorted((r.qid1, r.question1) for r in back.collect())
    assert got[0] == (1, 'a, "quoted"\nline')
    assert back.count() == 2


def test_partitioned_split_write_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid")], "pair_id long, split string")
    path = str(tmp_path / "splits")
    write_table(df, path, "split")
    t = spark.read.parquet(path).where(F.col("split") == "test")
    assert [r.pair_id for r in t.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in t._jdf.queryExecution().executedPlan().toString()


def test_model_save_load(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from paircraft.operators.experts import balanced_weights, expert_pipeline, feature_vector
    rows = [(float(i), float(i % 7), i % 2) for i in range(40)]
    df = feature_vector(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"])
    df = balanced_weights(df.withColumn("pair_id", F.monotonically_increasing_id()), "label", "w")
    m = expert_pipeline("lr", 40, 2, {"maxIter": 20}).fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    m2 = PipelineModel.load(str(tmp_path / "m"))
    a = [r.probability[1] for r in m.transform(df).orderBy("pair_id").collect()]
    b = [r.probability[1] for r in m2.transform(df).orderBy("pair_id").collect()]
    assert a == b
