import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paircraft.llm import langid


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(public_tokenizers.path(langid.VOCAB))


def all_segmentations(pieces, word, prob):
    at = {p: i for i, p in enumerate(pieces.names)}
    total, counts = 0.0, np.zeros(len(prob))
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, now = [], word[0]
        for c, ch in zip(cuts, word[1:], strict=True):
            if c:
                parts.append(now)
                now = ""
            now += ch
        parts.append(now)
        ids = [at.get(p, pieces.unknown if len(p) == 1 else -1) for p in parts]
        p = float(np.prod([prob[i] for i in ids]))
        total += p
        for i in ids:
            counts[i] += p
    return total, counts


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    raw = rng.random((len(pieces.names), 2)) / len(pieces.names)
    prob = langid.with_zero(raw)
    for word in ("▁the", "▁thatre", "▁ñandú", "▁日本", "▁a"):
        got = langid.forward(pieces, [word], prob)[0]
        out = np.zeros(len(prob) - 1)
        langid.expected(pieces, [word], np.array([3.0]), prob[:, 0], out)
        for lang in range(2):
            total, counts = all_segmentations(pieces, word, prob[:, lang])
            assert np.isclose(np.exp(got[lang]), total)
            if lang == 0:
                assert np.allclose(out, 3 * counts[:len(out)] / total)


def test_long_words_are_summed_whole(pieces, monkeypatch):
    """Scaled sums equal plain ones, and do not run out of range."""
    rng = np.random.default_rng(1)
    prob = langid.with_zero(rng.random((len(pieces.names), 2)) / len(pieces.names))
    words = ["▁internationalizationabcd", "▁donaudampfschifffahrtsge"]
    assert pieces.longest > 8 and len(words[0]) == len(words[1])
    monkeypatch.setattr(langid, "STRIDE", 10 ** 9)
    plain, counts = langid.forward(pieces, words, prob), np.zeros(len(prob) - 1)
    like = langid.expected(pieces, words, np.ones(2), prob[:, 0], counts)
    for stride in (1, 3, 7):
        monkeypatch.setattr(langid, "STRIDE", stride)
        again = np.zeros(len(prob) - 1)
        assert np.allclose(langid.forward(pieces, words, prob), plain)
        assert np.isclose(langid.expected(pieces, words, np.ones(2), prob[:, 0], again), like) and np.allclose(again, counts)
    assert np.isclose(like, plain[:, 0].sum())
    monkeypatch.undo()
    assert np.isfinite(langid.forward(pieces, ["▁" + "the" * 3000], prob)).all()
    again = np.zeros(len(prob) - 1)
    langid.expected(pieces, ["▁" + "the" * 300], np.ones(1), prob[:, 0], again)
    assert np.isfinite(again).all() and again.sum() > 200


def test_numerals_are_no_letters(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100, "² ½ ① Ⅷ 12", "en"), (101, "²the", "en")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[100] == "und" and got[101] == "en"


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert {r.doc_id for r in got} == set(truth)
    known = [r for r in got if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert len(known) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in known) / len(known) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_no_input_of_a_prediction(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "the and " * 5000, None), (104, "x" * 500, "en"),
           (104, "x" * 500, "en"), (None, "und die", "de")]
    docs = spark.createDataFrame([(*r, "p", 0.5) for r in rows + odd],
                                 "doc_id bigint, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs)
    assert got.count() == len(rows) + len(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de"
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_text_in_no_learned_language_is_told_by_its_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше по лесу к реке"
    more = docs.unionByName(spark.createDataFrame([(10 ** 6, foreign, None), (10 ** 6 + 1, None, "en"), (10 ** 6 + 2, "the", None)], docs.schema))
    kept = {r.doc_id for r in langid.in_learned_language(more, 0.5).collect()}
    assert not kept & {10 ** 6, 10 ** 6 + 1} and 10 ** 6 + 2 in kept
    have = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len(have - kept) <= 0.01 * len(have)
    assert langid.in_learned_language(docs.limit(0), 0.5).count() == 0


def test_bound_is_of_all_training_documents(spark, monkeypatch):
    """Not of the documents that the model was learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    told = langid.predict(docs, model).where(~langid.held_out("doc.doc_id") & (F.col("lang_pred") == F.col("doc.lang")) & (F.col("letters") >= 60))
    want = {}
    for r in told.groupBy("lang_pred").agg(F.collect_list("fit").alias("fit")).collect():
        low, middle = np.quantile(r.fit, [0.16, 0.5])
        want[r.lang_pred] = middle - langid.DEVIATIONS * max(middle - low, 0.1)
    monkeypatch.setattr(langid, "sample", None)
    got = {r.lang_pred: r.least for r in langid.usual_fit(docs, model).collect()}
    assert want and got == pytest.approx(want)
