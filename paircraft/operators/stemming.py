"""Porter stemming as a job.

Token arrays go to Python in Arrow batches as they lie; a task stems each
distinct token once and remembers it (a bounded memory in place of the
reference's per-process cache). No token is shuffled, so frequent tokens are
no hot keys. The stemmer is the published Porter (1980) algorithm.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paircraft.functions.text import char_count, clean_tokens, word_count

_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _V:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in ``stem``."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        while i < L and _cons(stem, i):
            i += 1
        n += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_c(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


# Suffix rules of the Porter (1980) algorithm, steps 2-4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_c(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # step 2, 3
    for rules in (_STEP2, _STEP3):
        for suf, rep in rules:
            if w.endswith(suf):
                if _m(w[:-len(suf)]) > 0:
                    w = w[:-len(suf)] + rep
                break
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[:-len(suf)]
            if _m(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or (_m(stem) == 1 and not _cvc(stem)):
            w = stem
    if _m(w) > 1 and _double_c(w) and w.endswith("l"):
        w = w[:-1]
    return w


#: Stems that a task remembers before it starts anew (bounds a worker's memory).
CACHE_STEMS = 300_000


class Stems(dict):
    """token -> stem, made once per task and token."""

    def __missing__(self, token: str) -> str:
        if len(self) >= CACHE_STEMS:
            self.clear()
        stem = self[token] = porter_stem(token) if token and token != "?" and "'" not in token else token
        return stem


def stem_column(df: DataFrame, key: str, tokens: str, out: str = "clean") -> DataFrame:
    """Stem the token arrays of ``df`` (key, tokens) and return (key, out)
    with the stemmed tokens joined by a space, in text order. Texts go to
    Python as they are dealt, so no token is shuffled; a null array gives ''."""

    def run(batches):
        stems = Stems()
        for b in batches:
            texts = [" ".join([stems[t] for t in row if t is not None]) if row else "" for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, out])
    return df.select(key, tokens).mapInArrow(run, T.StructType([df.schema[key], T.StructField(out, T.StringType())]))


def question_meta(questions: DataFrame, key: str = "qkey", text: str = "question") -> DataFrame:
    """(key, clean, len, words): cleaned + stemmed text and its char / word
    counts (X9); ``len`` and ``words`` are measured on the cleaned text."""
    toks = questions.select(key, clean_tokens(text).alias("_t"))
    st = stem_column(toks, key, "_t", "clean")
    return st.select(key, "clean", char_count("clean").alias("len"), word_count("clean").alias("words"))
