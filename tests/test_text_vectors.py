import pytest
from pyspark.sql import functions as F

from paircraft.functions.text import jaccard_token_set, joined_set, split_set
from paircraft.operators import tfidf

TEXTS = [("a", "red fox red hen"), ("b", "red fox blue hen"), ("c", "zebra only here"), ("d", ""), ("e", "hen red red fox")]
PAIRS = [("1", "a", "b"), ("2", "a", "a"), ("3", "b", "c"), ("4", "d", "d"), ("5", "a", "e"), ("6", "b", "a"), ("7", "a", "b"), ("8", "d", "a")]


@pytest.mark.parametrize("chars", [1, 10 ** 6])
@pytest.mark.parametrize("sublinear", [True, False])
def test_packed_vectors_give_the_cosines_of_the_long_weights(spark, monkeypatch, chars, sublinear):
    """However the texts are dealt into blocks."""
    monkeypatch.setattr(tfidf, "BLOCK_CHARS", chars)
    texts, pairs = spark.createDataFrame(TEXTS, "qkey string, clean string"), spark.createDataFrame(PAIRS, "pair_id string, qkey1 string, qkey2 string")
    tf = tfidf.pair_term_frequencies(texts)
    model = tfidf.fit_idf(tf, "qkey", F.lit(5), 2, sublinear)
    model.vocab = model.vocab.checkpoint()
    vectors = tfidf.text_vectors(texts, "clean", lambda df: tfidf.with_terms(df, "clean", "word"), model.vocab, sublinear).checkpoint()
    assert vectors.count() == len(TEXTS)
    got = {r.pair_id: r.cosine for r in tfidf.vector_cosine(pairs, vectors).collect()}
    want = {r.pair_id: r.cosine for r in tfidf.pair_cosine(pairs, model.transform(tf, "qkey")).collect()}
    assert got == pytest.approx(want) and got["2"] == 1 and got["3"] == got["4"] == got["8"] == 0 and 0 < got["1"] < 1


def test_no_row_for_each_term_of_a_pair(spark):
    """A pair meets two packed rows: its plan explodes nothing."""
    pairs = spark.createDataFrame(PAIRS, "pair_id string, qkey1 string, qkey2 string")
    vectors = spark.createDataFrame([], f"qkey string, {tfidf.VECTOR}")
    plan = tfidf.vector_cosine(pairs, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_token_set_as_one_string(spark):
    df = spark.createDataFrame([("The fox's 2 dens, the FOX",), ("",), ("the of",), ("?!",)], "t string")
    for r in df.select(jaccard_token_set("t").alias("a"), joined_set("t").alias("s")).select("a", split_set("s").alias("b")).collect():
        assert r.a == r.b


@pytest.mark.parametrize("name", ["jaccard", "token_containment", "numeric_block"])
def test_texts_are_read_per_distinct_text(spark, tmp_path, name):
    """Whole texts of all pairs are not joined: the query works from ids and keys."""
    import __spark_entry__ as E
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    kept, fx.doc_pairs = fx.doc_pairs, None
    try:
        assert E.queries()[name](spark, str(tmp_path)).count() >= 11
    finally:
        fx.doc_pairs = kept


def test_entries_are_packed_as_steps():
    """Ids, counts and document frequencies come back exactly, in a few bytes an entry."""
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (0, 1, 3000):
        ids = np.sort(rng.choice(10 ** 6, n, replace=False)).astype(np.int64)
        tf, df = rng.geometric(0.7, n).astype(np.int64), np.sort(rng.integers(1, 10 ** 5, n))[::-1].astype(np.int64)
        b = tfidf.packed(ids, tf, df)
        assert all(x.tolist() == y.tolist() for x, y in zip(tfidf.unpacked(b, n), (ids, tf, df), strict=True))
        assert len(b) < 5 * n + 16


def test_counts_of_first_sides_come_with_the_texts(spark, tmp_path):
    """The EDA cosine shuffles no text to learn how often it comes first; null partners count for nothing."""
    from paircraft.operators import eda
    from paircraft.sources import fixtures as fx
    rows = [(1, "red fox", "en", "s"), (2, "red hen", "en", "s"), (3, None, "en", "s"), (4, "red fox", "en", "s"), (5, "blue fox", "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    texts, kp = fx.pair_texts(spark, str(tmp_path)), fx.keyed_pairs(spark, str(tmp_path))
    first = {r.qkey1: r["count"] for r in kp.groupBy("qkey1").count().collect()}
    assert first and first == {r.qkey: r.m1 for r in texts.where("m1 > 0").collect()}
    with_counts = {r.pair_id: r.cosine for r in eda.eda_cosine(None, kp, texts).collect()}
    without = {r.pair_id: r.cosine for r in eda.eda_cosine(None, kp, texts.drop("m1")).collect()}
    assert with_counts == pytest.approx(without) and len(with_counts) == kp.count()


@pytest.mark.parametrize("name", ["unresolved_pairs", "encode_texts", "edit_ratio", "token_set_ratio"])
def test_only_what_is_asked_for_is_made(spark, tmp_path, monkeypatch, name):
    """Neither whole texts of all pairs nor cleaned texts are made where keys or raw texts do."""
    import __spark_entry__ as E
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (20, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = None
    if name == "unresolved_pairs":
        from paircraft.operators import tables
        known = spark.createDataFrame([("blue hen the 0", None), ("red fox the 0", None)], "question1 string, question2 string")
        want = {r.pair_id for r in tables.unresolved_pairs(fx.doc_pairs(spark, str(tmp_path)), tables.distinct_questions(known)).collect()}
    monkeypatch.setattr(fx, "doc_pairs", None)
    monkeypatch.setattr(fx, "pair_questions", None)
    got = E.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) > 3 and (want is None or {r.pair_id for r in got} == want)


@pytest.mark.parametrize("known", [False, True])
def test_word_vectors_write_no_text_again(spark, tmp_path, monkeypatch, known):
    """Only the cleaned texts are kept for the weights, or taken from the question table where it is there."""
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} the {i // 4}", "en", "s") for i in range(12)] + [(20, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {tuple(r) for r in fx.pair_texts(spark, str(tmp_path)).select("qkey", fx.F.length("question")).collect()}
    if known:
        fx.pair_questions(spark, str(tmp_path))
    monkeypatch.setattr(fx, "pair_questions", None)
    clean = fx.pair_clean(spark, str(tmp_path))
    assert clean.columns == ["qkey", "clean"] and {r.qkey for r in clean.collect()} == {k for k, _ in want}
    assert fx.tfidf_vectors(spark, str(tmp_path), "word").count() == len(want)


def test_blocks_are_dealt_in_rounds(spark, monkeypatch):
    """Each round is written before the next is dealt; all texts come out once, as in one round."""
    monkeypatch.setattr(tfidf, "BLOCK_CHARS", 12)
    texts = spark.createDataFrame([(f"k{i}", f"red fox {'hen ' * (i % 3)}w{i % 4}") for i in range(40)], "qkey string, clean string")
    vocab = tfidf.fit_idf(tfidf.pair_term_frequencies(texts), "qkey", F.lit(40)).vocab.checkpoint()
    got, written = {}, []
    kept = tfidf.checkpointed
    monkeypatch.setattr(tfidf, "checkpointed", lambda df: written.append(1) or kept(df))
    for rounds in (1, 4):
        monkeypatch.setattr(tfidf, "ROUNDS", rounds)
        got[rounds] = sorted(tuple(r) for r in tfidf.text_vectors(texts, "clean", lambda df: tfidf.with_terms(df, "clean", "word"), vocab, True).collect())
    assert got[1] == got[4] and len(got[1]) == 40 and len(written) == 5


@pytest.mark.parametrize("analyzer", ["word", "char"])
def test_model_of_distinct_texts(spark, analyzer):
    """A row for each text: the same vocabulary as from the long counts, whether the fit is bounded by keys or by rows."""
    texts = spark.createDataFrame([(f"k{i}", f"red fox {'hen ' * (i % 3)}w{i % 4} red fox") for i in range(40)] + [("none", "")], "qkey string, clean string")
    fit_on = texts.select("qkey").where("qkey <> 'k3' and qkey <> 'k7'")
    want = tfidf.fit_pair_tfidf(texts, analyzer, fit_on=fit_on)[0].vocab
    got = tfidf.fit_distinct(texts, analyzer, fit_on=fit_on)
    rows = lambda v: sorted((r.term, r.df, round(r.idf, 12)) for r in v.collect())
    assert rows(got.vocab) == rows(want) == rows(tfidf.fit_distinct(texts.join(fit_on, "qkey"), analyzer).vocab) and rows(want)
    assert got.sublinear == (analyzer == "word")
    plan = got.vocab._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 3, plan  # terms are counted once, not by text first


def test_scores_keep_neither_texts_nor_cleaned_texts(spark, tmp_path):
    """They are staged for the time that something is made of them, and the scores are those of texts that stay."""
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'Red fox' if i % 3 else 'blue hen'} jumps the {i // 4} times", "en", "s") for i in range(24)] + [(30, None, "en", "s")]
    made = []
    for name in ("alone", "texts", "clean"):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
        if name == "texts":
            fx.pair_texts(spark, sf)
        if name == "clean":
            fx.pair_clean(spark, sf)
        made.append(sorted(map(tuple, fx.scores(spark, sf).collect())))
        assert {k[1] for k in fx._MEMO if k[2] == sf} & {"pair_texts", "pair_clean"} == {"alone": set(), "texts": {"pair_texts"}, "clean": {"pair_texts", "pair_clean"}}[name]
    assert made[0] == made[1] == made[2] and len(made[0]) >= 60


def test_weight_sums_are_those_of_the_long_weights(spark):
    """Number, sum and largest weight of a text come from its packed row; a text without known terms has none."""
    texts = spark.createDataFrame(TEXTS, "qkey string, clean string")
    tf = tfidf.pair_term_frequencies(texts)
    model = tfidf.fit_idf(tf, "qkey", F.lit(5), 2, True)
    model.vocab = model.vocab.checkpoint()
    got = {r.qkey: r[1:] for r in tfidf.weight_sums(tfidf.text_vectors(texts, "clean", "word", model.vocab, True)).collect()}
    want = model.transform(tf, "qkey").groupBy("qkey").agg(F.count("w"), F.sum("w"), F.max("w")).collect()
    assert got.keys() == {r.qkey for r in want} == {"a", "b", "e"}
    assert all(got[r.qkey] == pytest.approx(r[1:]) for r in want)


def test_tfidf_weights_makes_no_long_table(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from paircraft.sources import fixtures as fx
    rows = [(i, f"{'red fox' if i % 3 else 'blue hen'} jumps {i // 4}", "en", "s") for i in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(tfidf, "pair_term_frequencies", None)
    got = E.queries()["tfidf_weights"](spark, str(tmp_path)).collect()
    assert len(got) >= 6 and all(r.n_terms > 0 and 0 < r.max_w <= 1 for r in got)
    assert not [k for k in fx._MEMO if k[1] == "tfidf:word:w" and k[2] == str(tmp_path)]
