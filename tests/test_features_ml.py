import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from paircraft.operators import feature_blocks as FB
from paircraft.sources import model_store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(WORDS, size=6))
    rows = []
    for i in range(40):
        a = text()
        b = a if i % 4 == 0 else a + " omega" if i % 4 == 1 else text()
        rows.append((f"p{i}", a, b, int(i % 4 < 2)))
    return spark.createDataFrame(rows + [("null", "alpha", None, 0)], "pair_id string, question1 string, question2 string, label int").repartition(3).cache()


def test_width_order_and_switches(pairs):
    stage = FB.PairFeatures(dim=8, wordComponents=4, charComponents=3, passes=2, minDf=1)
    model = stage.fit(pairs)
    assert stage.width == 26 + 4 * 8 + 2 * (4 + 3) and FB.PairFeatures().width == 526 + 4 * 384
    rows = {r.pair_id: r for r in model.transform(pairs).collect()}
    assert rows["null"].features is None and len(rows) == 41
    assert all(len(r.features) == stage.width for k, r in rows.items() if k != "null")
    same = rows["p0"].features  # two equal texts
    assert same[:2] == pytest.approx([1.0, 1.0])
    u, v, gap, prod = (np.array(same[2 + 8 * i:10 + 8 * i]) for i in range(4))
    assert np.array_equal(u, v) and not gap.any() and np.allclose(prod, u * v)
    assert same[34:39] == [1.0, 1.0, 0.0, 0.0, 1.0]  # fuzzy, overlap
    assert same[57] == 1.0  # scorer
    assert np.allclose(same[58:62], same[62:66]) and np.allclose(same[66:69], same[69:72])
    small = FB.PairFeatures(blocks=["overlap", "fuzzy"])
    assert small.width == 5
    got = {r.pair_id: r.features for r in small.fit(pairs).transform(pairs).collect()}
    assert got["p1"] == rows["p1"].features[34:39]
    with pytest.raises(ValueError):
        FB.PairFeatures(blocks=["nothing"]).fit(pairs)


def test_pipeline_saved_and_loaded(pairs, tmp_path):
    some = pairs.where("question2 is not null")
    stages = [FB.PairFeatures(dim=8, blocks=["dense", "overlap", "numeric", "scorer"]), FB.PairReducer(share=0.9), FB.PairExpert(kind="gbt", rounds=5)]
    model = Pipeline(stages=stages).fit(some)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ({r.pair_id: r.p for r in m.transform(some).collect()} for m in (model, again))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_term_block_saved_and_loaded(pairs, tmp_path):
    some = pairs.where("question2 is not null")
    texts = FB.PairTexts(some)
    model = FB.TermBlock(analyzer="word", components=2, passes=1, minDf=1).fit_texts(texts)
    model.write().save(str(tmp_path / "t"))
    a, b = ({r.pair_id: r for r in m.block(texts).collect()} for m in (model, FB.TermBlockModel.load(str(tmp_path / "t"))))
    assert a == b and len(a["p0"].svd_word) == 4


@pytest.mark.parametrize("kind", ["lr", "svm", "rf", "gbt_deep"])
def test_experts_learn_and_are_saved(spark, kind, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = (x @ [2.0, -1.0] > 0).astype(int)
    df = spark.createDataFrame([(f"p{i}", [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "pair_id string, reduced array<double>, label int")
    model = FB.PairExpert(kind=kind, rounds=15).fit(df)
    model.write().save(str(tmp_path / kind))
    got = FB.PairExpertModel.load(str(tmp_path / kind)).transform(df)
    assert got.agg(F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0] > 0.9
    with pytest.raises(ValueError):
        FB.PairExpert(kind="other").fit(df)


def test_numeric_block_keeps_the_training_edges(spark, pairs):
    model = FB.NumericBlock().fit(pairs.where("question2 is not null"))
    other = spark.createDataFrame([("a", "x y", "x y z")], "pair_id string, question1 string, question2 string")
    again = model.copy()
    assert again.getOrDefault("edges") == model.getOrDefault("edges") and len(model.getOrDefault("edges")) >= 2
    assert len(model.transform(other).first().numeric) == 18


def test_model_store_fits_once_per_content(spark, pairs, tmp_path, monkeypatch):
    fits = []
    real = FB.PairFeatures._fit
    monkeypatch.setattr(FB.PairFeatures, "_fit", lambda self, df: fits.append(1) or real(self, df))
    some = pairs.where("question2 is not null").select("pair_id", "question1", "question2")
    load = lambda df, **k: model_store.load_or_fit(FB.PairFeatures(blocks=["overlap", "numeric"], **k), df, FB.PairFeaturesModel, str(tmp_path))
    first, second = load(some), load(some.orderBy("pair_id"))
    assert len(fits) == 1 and first.stages[1].getOrDefault("edges") == second.stages[1].getOrDefault("edges")
    load(some, dim=16)  # another param
    changed = some.withColumn("question1", F.when(F.col("pair_id") == "p0", "other").otherwise(F.col("question1")))
    load(changed)
    load(some.unionByName(some.limit(1)))  # a repeated row
    assert len(fits) == 4


def test_keyed_pairs_give_the_blocks_of_whole_pairs(spark, pairs):
    """Pairs of content keys and the texts' table instead of whole texts: the same blocks."""
    whole = FB.PairTexts(pairs.where("question2 is not null"))
    keyed = FB.PairTexts(whole.keys, whole.questions)
    stage = FB.PairFeatures(blocks=["overlap", "numeric"])
    a, b = ({r.pair_id: r.features for r in stage.fit_texts(t).block(t).collect()} for t in (whole, keyed))
    assert a and a == b
    assert {tuple(r) for r in whole.pairs.collect()} == {tuple(r) for r in keyed.pairs.collect()}


def test_stored_features_join_no_text_to_a_pair(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fx, "doc_pairs", None)
    got = {r.pair_id: list(r.lengths) for r in E.queries()["stored_features"](spark, str(tmp_path)).collect()}
    assert len(got) >= 11 and got["0-1"] == [10.0, 9.0, 1.0]


def test_raw_feature_block_joins_no_text_to_a_pair(spark, tmp_path, monkeypatch):
    """Characters and words are counted per distinct text: the numbers of whole pairs."""
    import __spark_entry__ as E
    from paircraft.functions.similarity import length_diffs
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox  ' if i % 3 else 'blue hen and'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s"), (21, "", "en", "s")]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    whole = fx.doc_pairs(spark, sf).dropna(subset=["question1", "question2"])
    want = {r[0]: [float(r[1]), float(r[2])] for r in whole.select("pair_id", *length_diffs("question1", "question2")).collect()}
    monkeypatch.setattr(fx, "doc_pairs", None)
    got = {r.pair_id: r for r in E.queries()["raw_feature_block"](spark, sf).collect()}
    assert {k: list(r.features[2:4]) for k, r in got.items()} == want and len(want) >= 11 and all(r.width == 23 for r in got.values())
