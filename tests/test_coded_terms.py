import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paircraft.functions import text as T
from paircraft.operators import coded_terms, tfidf
from paircraft.sources import fixtures as fx

ODD = [None, "", " ", "a", "a b", "the fox's 2 dens, the FOX?? no", "[MATH]x\ny[/math] z", "a <b unclosed <i>q</i>r", "ﬁne ß Ünïcödé ½ 𝐀 Ǆ", "İstanbul K 中文字 ²x",
       "aa\tbb  cc\n\n dd", "x_y __ _ 9 10", "zzz zzz zzz", "é\U0001f600xyz\U0001f600 é é", "don't can't won't'", "a\x00b\x0bc  \x1f d"]


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(4)
    made = [" ".join(random.choice(["Red", "fox", "ünd", "hen", "a", "b2", "the", "x?y", "naïve"]) for _ in range(random.randrange(12))) for _ in range(60)]
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(ODD + made)], "qkey string, t string").repartition(3).cache()


def test_texts_read_in_batches_equal_the_column_steps(texts):
    """Cleaning, token sets and block keys in Arrow batches give what the built-in expressions give."""
    block = F.sha2(F.regexp_replace(F.lower("t"), fx.BLOCK_KEEP, " ").cast("binary"), 256)
    for r in texts.select("t", T.clean_nostem("t").alias("a"), F.array_join(T.clean_tokens("t"), " ").alias("b"), T.joined_set("t").alias("c"),
                          F.array_join(T.jaccard_token_set("t"), " ").alias("d"), fx.block_key(F.col("t")).alias("e"), block.alias("f")).collect():
        assert r.a == r.b and r.c == r.d and r.e == r.f, r.t
    assert hashlib.sha256(re.sub(fx.BLOCK_KEEP, " ", "a, b!".lower()).encode()).hexdigest() in {r[0] for r in texts.limit(1).select(fx.block_key(F.lit("a, b!"))).collect()}


@pytest.mark.parametrize("chars", [7, 10 ** 6])
@pytest.mark.parametrize("analyzer", ["word", "char", "list"])
def test_terms_as_numbers_are_the_terms(spark, texts, monkeypatch, analyzer, chars):
    """Every (text, term, count), and the document frequencies, however many characters are coded at a time."""
    monkeypatch.setattr(coded_terms, "CHUNK_CHARS", dict.fromkeys(coded_terms.CHUNK_CHARS, chars))
    kind = "word" if analyzer == "list" else analyzer
    terms_of = (lambda df: tfidf.with_terms(df, "t", "word")) if analyzer == "list" else analyzer
    want = {}
    for r in tfidf.with_terms(texts, "t", kind).collect():
        for term in r.terms:
            want[r.qkey, term] = want.get((r.qkey, term), 0) + 1
    made, how = coded_terms.with_pieces(texts, "t", terms_of)
    own = made.select("qkey", "text", "given").toArrow()
    row, place, count, terms = coded_terms.counted(own, how)
    keys, names = own.column("qkey").to_pylist(), terms.to_pylist()
    got = {(keys[i], names[j]): n for i, j, n in zip(row.tolist(), place.tolist(), count.tolist(), strict=True)}
    assert got == want and len(got) == len(row)
    assert sorted(coded_terms.distinct_terms(own, how).to_pylist()) == sorted({t for _, t in want})
    frequencies = {r.term: r.df for r in coded_terms.document_frequencies(texts, "t", terms_of, chars=100 * chars).collect()}
    assert frequencies == {t: sum(u == t for _, u in want) for _, t in want}


@pytest.mark.parametrize("analyzer", ["word", "char"])
def test_no_array_of_terms_is_made_of_a_plain_text(spark, texts, analyzer):
    """The n-grams of a text stand in no row: neither of its fit nor of its vector."""
    vocab = tfidf.fit_distinct(texts, analyzer, "t").vocab
    plan = vocab._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "array_distinct" not in plan and "MapInArrow" in plan
