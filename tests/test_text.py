import re
import unicodedata

from pyspark.sql import functions as F

from paircraft.functions import text as T

EDGE = [None, "", "the and of", "?", "Don't", "[MATH]x\ny[/math] z", "a <b unclosed", "ﬁne", "ß", "Ünïcödé ½ 𝐀"]


def ref_fold(s):
    return unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode("ascii").lower()


def test_ascii_fold_matches_unicodedata(spark):
    df = spark.createDataFrame([(s,) for s in EDGE], "t string")
    got = [r[0] for r in df.select(T.ascii_fold("t")).collect()]
    assert got == [ref_fold(s) for s in EDGE]


def test_clean_nostem_edges(spark):
    df = spark.createDataFrame([(s,) for s in EDGE], "t string")
    got = [r[0] for r in df.select(T.clean_nostem("t")).collect()]
    assert got[0] == "" and got[1] == "" and got[2] == ""
    assert got[3] == "?"
    assert got[4] == "don't" or got[4] == ""  # stop word in the list -> removed
    assert "x" not in got[5].split() and got[5].endswith("z")
    assert got[6] == "unclosed" or "b" in got[6]
    assert got[7] == "fine"
    assert got[8] == ""


def test_ngrams(spark):
    df = spark.createDataFrame([("aa bb cc",), ("",), ("abcd",)], "t string")
    w = T.with_word_ngrams(df, "t", "g").collect()
    assert w[0].g == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert w[1].g == []
    c = T.with_char_ngrams(df, "t", "g").collect()
    assert c[2].g == ["abc", "bcd", "abcd"]
    assert c[1].g == []


def test_char_ngrams_are_matched_not_sliced(spark):
    """All overlapping n-grams of whole characters, without a call for each of them."""
    from paircraft.functions import text as T
    rows = ["abcdef", "a\nb\r\u2028c", "", None, "ab", "é\U0001f600xyz\U0001f600", "A  B \t c"]
    df = T.with_char_ngrams(spark.createDataFrame([(t,) for t in rows], "t string"), "t", "g")
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        s = re.sub(r"[ \t\n\x0b\f\r]{2,}", " ", (r.t or "").lower())
        assert r.g == [s[i:i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)]


def test_bad_characters_as_ranges(spark):
    """The ranges hold the characters that the negated class does."""
    from paircraft.functions import text as T
    from paircraft.schema import BAD_CHR_RE
    rows = [(f"{chr(i)}a{chr(i)}{chr(i)} ",) for i in [*range(0xD800), *range(0xE000, 0x10000), 0x1F600, 0x10FFFF]] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~T.keep_basic_chars("t").eqNullSafe(F.regexp_replace("t", BAD_CHR_RE, " "))).count() == 0
    assert "[^" not in T.BAD_CHR_RANGES
