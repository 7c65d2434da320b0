"""Terms of texts as numbers (X13, X14): n-grams are made, counted and made
distinct as integers, a batch of texts at a time; a string is made once for
each distinct term of a batch.

``with_pieces`` prepares the columns that the functions here take: ``text``
(lower case; whitespace collapsed for characters) and ``given``, the tokens or
n-grams that Spark's expressions find where a text is not plain ASCII (null
elsewhere). The terms are those of ``functions.text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.functions import text as T
from paircraft.schema import CHAR_NGRAMS, WORD_NGRAMS

#: Characters that are coded at a time by analyzer (characters give three n-grams each), and texts.
CHUNK_CHARS = {"word": 16_000_000, "char": 1_000_000, "list": 16_000_000}
CHUNK_ROWS = 65_536

_WORD = np.array([chr(b).isalnum() or chr(b) == "_" for b in range(128)] + [False] * 128)


def with_pieces(df: DataFrame, text_col: str, terms_of: str | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """``df`` with ``text`` and ``given``, and how to read them: "word" or
    "char", or "list" where ``terms_of`` adds the array column ``terms``."""
    if callable(terms_of):
        return terms_of(df).withColumn("text", F.lit("")).withColumnRenamed("terms", "given"), "list"
    text = F.coalesce(F.lower(text_col), F.lit("")) if terms_of == "word" else T.char_text(text_col)
    df = df.withColumn("text", text)
    given = T.word_tokens(text_col) if terms_of == "word" else T.char_ngrams_of("text", *CHAR_NGRAMS)
    return df.withColumn("given", F.when(F.col("text").rlike(T.NON_ASCII_RE), given)), terms_of


def _ascii_rows(text: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the plain rows, where each starts (and the last one ends), and which rows they are."""
    at = np.flatnonzero(plain)
    text = text.take(pa.array(at)).cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    b = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, ends - ends[0], at


def _tokens(text: pa.Array, given: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) in text order, row by row: runs of two or more word characters."""
    plain = given.is_null().to_numpy(zero_copy_only=False)
    b, ends, at = _ascii_rows(text, plain)
    word = _WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    last = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    size = last - first
    word[first[size < 2]] = False
    first, size = first[size >= 2], size[size >= 2]
    found = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(b[word].tobytes()))
    row = at[np.searchsorted(ends, first, "right") - 1] if len(first) else np.zeros(0, np.int64)
    if plain.all():
        return row, found
    return np.r_[row, pc.list_parent_indices(given).to_numpy().astype(np.int64)], pa.concat_arrays([found, given.flatten().cast(pa.string())])


def _word_codes(text: pa.Array, given: pa.Array, n_max: int) -> Iterator[tuple]:
    row, tokens = _tokens(text, given)
    coded = tokens.dictionary_encode()
    words, a = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(len(words), 1)
    rows, codes = [row], [a]
    if n_max == 2:
        near = np.flatnonzero(row[1:] == row[:-1])
        rows.append(row[near])
        codes.append(n + a[near] * n + a[near + 1])

    def names(u: np.ndarray) -> pa.Array:
        one, two = u[u < n], u[u >= n] - n
        return pa.concat_arrays([words.take(pa.array(one)), pc.binary_join_element_wise(words.take(pa.array(two // n)), words.take(pa.array(two % n)), " ")])
    yield np.concatenate(rows), np.concatenate(codes), n + n * n, names


def _char_codes(text: pa.Array, given: pa.Array) -> Iterator[tuple]:
    plain = given.is_null().to_numpy(zero_copy_only=False)
    b, ends, at = _ascii_rows(text, plain)
    lo, hi = CHAR_NGRAMS
    bits = 7 * hi
    wide, left = b.astype(np.int64), np.repeat(ends[1:], np.diff(ends)) - np.arange(len(b))
    of = np.repeat(at, np.diff(ends))
    code, rows, codes = wide, [], []
    for n in range(2, hi + 1):
        code = (code[:-1] << 7) | wide[n - 1:] if len(code) else code
        if n >= lo:
            there = left[:len(code)] >= n
            rows.append(of[:len(code)][there])
            codes.append((n << bits) | code[there])

    def names(u: np.ndarray) -> pa.Array:
        out = []
        for n in range(lo, hi + 1):
            mine = u[u >> bits == n]
            chars = np.stack([(mine >> (7 * (n - 1 - k))) & 127 for k in range(n)], axis=1).astype(np.uint8)
            out.append(pa.StringArray.from_buffers(len(mine), pa.py_buffer((np.arange(len(mine) + 1) * n).astype(np.int32).tobytes()), pa.py_buffer(chars.tobytes())))
        return pa.concat_arrays(out)
    yield np.concatenate(rows), np.concatenate(codes), (hi + 1) << bits, names
    if not plain.all():
        yield from _list_codes(given)


def _list_codes(given: pa.Array) -> Iterator[tuple]:
    coded = given.flatten().cast(pa.string()).dictionary_encode()
    yield (pc.list_parent_indices(given).to_numpy().astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
           max(len(coded.dictionary), 1), lambda u: coded.dictionary.take(pa.array(u)))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _chunks(own: pa.Table, how: str) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Some rows at a time: the number of the first, texts and given terms."""
    text, given = _whole(own.column("text")), _whole(own.column("given"))
    size = pc.add(pc.binary_length(text), pc.fill_null(pc.multiply(pc.list_value_length(given), 8), 0) if how == "list" else 0)
    part = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_CHARS[how]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for s in range(a, z, CHUNK_ROWS):
            e = min(s + CHUNK_ROWS, z)
            yield s, text.slice(s, e - s), given.slice(s, e - s)


def _codes(how: str, text: pa.Array, given: pa.Array) -> Iterator[tuple]:
    """(row, code, codes below, names of codes in order) of every occurrence."""
    if how == "word":
        return _word_codes(text, given, WORD_NGRAMS[1])
    return _char_codes(text, given) if how == "char" else _list_codes(given)


def distinct_terms(own: pa.Table, how: str) -> pa.Array:
    """The distinct terms of the texts."""
    found = []
    for _, text, given in _chunks(own, how):
        for _, code, _, names in _codes(how, text, given):
            code.sort()
            found.append(names(code[np.r_[True, code[1:] != code[:-1]][:len(code)]]))
    if len(found) == 1:
        return found[0]
    return pa.concat_arrays(found).unique() if found else pa.array([], pa.string())


def counted(own: pa.Table, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, count) of the terms of each text, a term of a text once, in no order, and the terms by place."""
    rows, places, counts, terms, n = [], [], [], [], 0
    for s, text, given in _chunks(own, how):
        many = max(len(text), 1)
        for row, code, below, names in _codes(how, text, given):
            u = None
            if below * many >= 1 << 62:
                u, code = np.unique(code, return_inverse=True)
            # by code, then by text: one sort makes both the entries and the terms distinct
            key = code * many + row
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            counts.append(np.diff(np.r_[first, len(key)]).astype(np.int32))
            code, row = np.divmod(key[first], many)
            rows.append((row + s).astype(np.int32))
            new = np.r_[True, code[1:] != code[:-1]][:len(code)]
            places.append((np.cumsum(new) - 1 + n).astype(np.int32))
            there = code[new]
            terms.append(names(there if u is None else u[there]))
            n += len(there)
    if not terms:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), pa.array([], pa.string())
    if len(terms) == 1:
        return rows[0], places[0], counts[0], terms[0]
    coded = pa.concat_arrays(terms).dictionary_encode()
    return np.concatenate(rows), coded.indices.to_numpy(zero_copy_only=False)[np.concatenate(places)], np.concatenate(counts), coded.dictionary


def document_frequencies(texts: DataFrame, text_col: str, terms_of: str | Callable[[DataFrame], DataFrame], weight: str | None = None,
                         chars: int = 16_000_000) -> DataFrame:
    """(term, df): how many of the texts hold each term (or the sum of their
    ``weight``); a task counts ``chars`` characters of texts (a quarter for n-grams of
    characters) before it sends a row a term."""
    made, how = with_pieces(texts, text_col, terms_of)
    one = (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            own = pa.Table.from_batches(held)
            row, place, _, terms = counted(own, how)
            n = np.bincount(place, own.column("one").to_numpy()[row], len(terms)).astype(np.int64)
            return pa.RecordBatch.from_arrays([terms, pa.array(n)], ["term", "df"])

        held, size, most = [], 0, chars // 4 if how == "char" else chars
        for b in batches:
            step = max(1, b.num_rows * most // max(b.nbytes, 1))  # a batch has a number of rows, whatever their length
            for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                held.append(part)
                size += part.nbytes
                if size >= most:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return made.select("text", "given", one).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
