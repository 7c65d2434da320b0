"""Text cleaning and tokenising as native column expressions.

Everything here is a ``Column -> Column`` function; most stay inside
whole-stage codegen. ``clean_nostem`` and ``joined_set`` read whole texts in
Arrow batches; the Porter stem (X7) is in ``paircraft.operators.stemming``.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paircraft.schema import (HTML_RE, JACCARD_TOKEN_RE, MATH_RE,
                              TOKEN_RE, ascii_fold_tables, stop_words)

NON_ASCII_RE = r"[^\x00-\x7F]"
#: ``BAD_CHR_RE`` without its negation, as ranges: Java matches it several times as fast.
BAD_CHR_RANGES = r"[\x00-\x1F!-&(-/:->@-`{-\x{10FFFF}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@functools.lru_cache(maxsize=None)
def multi_fold_class() -> str:
    _, _, multi = ascii_fold_tables()
    return "[" + "".join(re.escape(ch) for ch, _ in multi) + "]"


@functools.lru_cache(maxsize=None)
def _multi_fold_map_args() -> tuple:
    _, _, multi = ascii_fold_tables()
    return tuple(x for ch, rep in multi for x in (ch, rep))


def ascii_fold(col) -> Column:
    """NFKD fold to ASCII, drop what has no ASCII part, lower case.

    Single-letter folds are one ``translate``; multi-letter folds (ligatures,
    fractions) are a literal map applied per character, only on rows that
    contain one of those rare characters (checked by one regex scan).
    """
    src, dst, multi = ascii_fold_tables()
    t = F.translate(F.coalesce(_c(col), F.lit("")), src, dst)
    if multi:
        m = F.create_map(*[F.lit(x) for x in _multi_fold_map_args()])
        # ASCII runs stay whole; each remaining non-ASCII character is looked up
        pieces = F.regexp_extract_all(t, F.lit("[\\x00-\\x7F]+|(?s)."), 0)
        mapped = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(m, p), p)), "")
        t = F.when(t.rlike(NON_ASCII_RE), mapped).otherwise(t)
    return F.lower(F.regexp_replace(t, NON_ASCII_RE, ""))


def strip_math(col) -> Column:
    """Remove ``[math]...[/math]`` blocks, lazy, dot-all, any case."""
    return F.regexp_replace(_c(col), MATH_RE, " ")


def strip_html(col) -> Column:
    """Remove HTML tags."""
    return F.regexp_replace(_c(col), HTML_RE, " ")


def strip_markup(col) -> Column:
    return strip_html(strip_math(col))


def keep_basic_chars(col) -> Column:
    """Everything but ``a-z 0-9 ' ?`` and space becomes a space."""
    return F.regexp_replace(_c(col), BAD_CHR_RANGES, " ")


def stop_word_array() -> Column:
    return F.array(*[F.lit(w) for w in stop_words()])


def drop_stop_words(tokens) -> Column:
    """Keep order and repeats; ``isin`` on a long literal list becomes a hash
    set (InSet) in the optimized plan (X6)."""
    sw = list(stop_words())
    return F.filter(_c(tokens), lambda t: ~t.isin(*sw))


def clean_tokens(col) -> Column:
    """Fold, strip markup, keep basic characters, tokenise, drop stop
    words. Returns ``array<string>`` in text order (no stemming)."""
    t = keep_basic_chars(strip_html(strip_math(ascii_fold(col))))
    toks = F.regexp_extract_all(t, F.lit(TOKEN_RE), 0)
    return drop_stop_words(toks)


@functools.lru_cache(maxsize=None)
def _cleaner():
    """``clean_tokens`` joined, of one text: the same steps on plain strings."""
    src, dst, multi = ascii_fold_tables()
    fold = {ord(a): b for a, b in zip(src, dst)} | {ord(a): b for a, b in multi}
    folded = re.compile(r"[^\x00-\x7F]+")
    math, html = re.compile(MATH_RE), re.compile(HTML_RE)
    kept = {i: chr(i) if re.match(r"[a-z0-9']", chr(i)) else " " for i in range(128)} | {ord("?"): " ? "}
    ignored = frozenset(stop_words())

    def clean(text: str) -> str:
        if not text.isascii():
            text = folded.sub(lambda m: "".join([fold.get(ord(c), "") for c in m.group()]), text)
        text = text.lower()
        if "[math]" in text:
            text = math.sub(" ", text)
        if "<" in text:
            text = html.sub(" ", text)
        return " ".join([w for w in text.translate(kept).split() if w not in ignored])
    return clean


def clean_nostem(col) -> Column:
    """Cleaned text without stemming: the ``clean_tokens`` joined by one space.
    A call per text in Arrow batches: Java's regular expressions take several
    times as long for the same steps."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        clean = _cleaner()
        return pa.array([clean(t) if t else "" for t in texts.to_pylist()], pa.string())
    return cleaned(_c(col))


def jaccard_token_set(col) -> Column:
    """Token set used by the Jaccard feature: ``[a-z0-9']+`` on the lower-cased
    raw text, stop words removed, duplicates removed (X8 input)."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))),
                                F.lit(JACCARD_TOKEN_RE), 0)
    return F.array_except(toks, stop_word_array())


def joined_set(col) -> Column:
    """``jaccard_token_set`` as one string (its tokens hold no space): shorter
    rows to shuffle than an array, made by a call per text in Arrow batches."""

    @F.arrow_udf("string")
    def joined(texts: pa.Array) -> pa.Array:
        kept = bytes(i if re.match(rb"[a-z0-9']", bytes([i])) else 32 for i in range(256))
        ignored = frozenset(w.encode() for w in stop_words())
        # the letters that count are ASCII: a text is lowered as characters, then read as bytes
        return pa.array([b" ".join([w for w in dict.fromkeys(t.lower().encode("utf-8", "replace").translate(kept).split()) if w not in ignored]).decode()
                         if t else "" for t in texts.to_pylist()], pa.string())
    return joined(_c(col))


def split_set(col) -> Column:
    """The token set of ``joined_set``."""
    return F.when(_c(col) == "", F.array().cast("array<string>")).otherwise(F.split(_c(col), " "))


def word_count(col) -> Column:
    """Number of whitespace-separated words (``len(s.split())``) (F2)."""
    return F.size(F.filter(F.split(F.coalesce(_c(col), F.lit("")), r"\s+"),
                           lambda w: w != "")).cast("bigint")


def char_count(col) -> Column:
    return F.length(_c(col)).cast("bigint")


def _gram_at(toks: Column, n: int):
    # one-argument lambda: transform() treats a two-argument lambda as (x, index)
    return lambda i: F.array_join(F.slice(toks, i + 1, n), " ")


# The n-gram builders reference their token array or text many times (also
# inside lambdas, once per element). They therefore take the array as an
# already projected column and are used through the DataFrame helpers below,
# which project the array first; a non-trivial expression would otherwise be
# re-evaluated for every n-gram.

def word_tokens(col) -> Column:
    """The default vectorizer token rule: two or more Unicode word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)


def word_ngrams_of(toks: str, n_min: int = 1, n_max: int = 2) -> Column:
    """Word n-grams of a projected token-array column, n in [n_min, n_max]."""
    t = F.col(toks)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(t)
            continue
        grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), _gram_at(t, n))
        parts.append(F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def char_text(col) -> Column:
    """The lower-cased text with whitespace runs collapsed."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), r"\s\s+", " ")


def char_ngrams_of(text: str, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams of a projected column of ``char_text`` (X14): a
    look-ahead matches at each character that has n - 1 more after it and
    takes them, so the work is linear in the text length."""
    return F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))."), 1) for n in range(n_min, n_max + 1)]))


def with_word_ngrams(df, text_col: str, out: str, n_min: int = 1, n_max: int = 2):
    return (df.withColumn("_wtok", word_tokens(text_col))
              .withColumn(out, word_ngrams_of("_wtok", n_min, n_max)).drop("_wtok"))


def with_char_ngrams(df, text_col: str, out: str, n_min: int = 3, n_max: int = 5):
    return (df.withColumn("_chars", char_text(text_col))
              .withColumn(out, char_ngrams_of("_chars", n_min, n_max)).drop("_chars"))
