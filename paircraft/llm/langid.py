"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the letter pieces of a sentencepiece
model, a word's first piece marked as such. Each language has a probability
for every piece; a word's probability is the sum over all its segmentations
into pieces, found by the forward algorithm, and a text's is the product over
its words. The probabilities are learned by expectation maximisation: expected
piece counts over all segmentations (forward and backward sums) of the words
of the training texts, computed in tasks and summed by Spark.

Training looks at a bounded sample, ``SAMPLE_DOCS`` documents of each language
(those of the smallest id hashes) whose fold is not held out; whole texts are
read, and the model is a table of pieces x languages.

A text that is null or has no letter is ``und`` with score 0, as is every text
if there was nothing to learn from. Ties go to the language first in order.
Languages that are null are no training rows; repeated rows count each; extra
columns are ignored. Pieces of all lengths and words of all lengths count
whole: the sums over long words are scaled on the way. Training ends when a
round raises the log-likelihood by less than ``GAIN`` of itself.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paircraft.llm.common import CACHE_ENTRIES, cut, slices, word_crc
from paircraft.plans.ordered import exact_quantiles

VOCAB = "piece_bpe_32k.model"
#: Documents per language to learn from; rounds at most; relative gain of the last round; pseudo-count.
SAMPLE_DOCS, ROUNDS, GAIN, PSEUDO = 200, 30, 5e-4, 0.1
#: Letters after which the sums of a long word are scaled.
STRIDE = 24
#: Probability of a letter that is no piece, in any language.
UNKNOWN = 1e-7
START = "▁"
LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(word_crc(id_col) % 3 == 1, F.lit(False))


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case, marked at their start."""
    return [START + w for w in LETTERS.findall(text.lower())]


class Pieces:
    """Vocabulary lookups of all parts of many words at once. A part's hash is
    a polynomial in its code points; each length has a sorted table."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        ok = [p for p in found if (b := p.removeprefix(START)) and b.isalpha()] + [START]
        self.names = sorted(set(ok))
        self.longest = max(map(len, self.names))
        self.unknown = len(self.names)  # its row: a single letter outside the vocabulary
        by_length = defaultdict(list)
        for i, p in enumerate(self.names):
            by_length[len(p)].append((int(self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]), i))
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]))

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h + codes[:, k]) * _BASE
        return h

    def parts(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, length, piece or -1 of each word), by begin; words have one length."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = (h + codes[:, i + k - 1]) * _BASE
                if k not in self.tables:
                    continue
                known, ids = self.tables[k]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                yield i, k, np.where(known[at] == h, ids[at], self.unknown if k == 1 else -1)


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The vocabulary, read once per worker."""
    return Pieces(path)


def forward(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log-probabilities (words x languages) of words of one length; ``prob``
    (pieces x languages) ends with the rows of unknown letters and of zeros.
    Only the sums within a piece's reach are kept."""
    n, reach = len(words[0]), pieces.longest + 1
    alpha = np.zeros((reach, len(words), prob.shape[1]))
    alpha[0] = 1
    scale, now = np.zeros(alpha.shape[1:]), 0
    for i, k, ids in pieces.parts(words):
        if i != now:
            alpha[now % reach] = 0
            now = i
            if i % STRIDE == 0:
                scale += np.log(alpha[i % reach])
                alpha /= alpha[i % reach].copy()
        alpha[(i + k) % reach] += alpha[i % reach] * prob[ids]
    return np.log(alpha[n % reach]) + scale


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, prob: np.ndarray, out: np.ndarray) -> float:
    """Add the expected piece counts of words of one length to ``out``, and
    return their log-likelihood; ``prob`` and ``out`` are one language's."""
    n = len(words[0])
    spans = list(pieces.parts(words))
    alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    alpha[0], beta[n] = 1, 1
    # logarithms of what the sums up to a place, and from a place on, were divided by
    before, after = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    now = 0
    for i, k, ids in spans:
        if i != now:
            now = i
            if i % STRIDE == 0:
                before[i:] += np.log(alpha[i])
                alpha[i:] /= alpha[i].copy()
        alpha[i + k] += alpha[i] * prob[ids]
    now = n
    for i, k, ids in reversed(spans):
        if i + 1 < now:
            now = i + 1
            if now % STRIDE == 0:
                # those within a piece's reach are read again
                after[:now + pieces.longest] += np.log(beta[now])
                beta[now:now + pieces.longest] /= beta[now].copy()
        beta[i] += beta[i + k] * prob[ids]
    total = np.log(alpha[n]) + before[n]
    for i, k, ids in spans:
        hit = ids >= 0
        size = np.exp(before[i][hit] + after[i + k][hit] - total[hit]) * counts[hit]
        out += np.bincount(ids[hit], alpha[i][hit] * prob[ids[hit]] * beta[i + k][hit] * size, len(out))
    return float(total @ counts)


def by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


def with_zero(prob: np.ndarray) -> np.ndarray:
    """Rows for unknown letters and, at -1, for parts that are no piece."""
    return np.concatenate([prob, np.full((1, *prob.shape[1:]), UNKNOWN), np.zeros((1, *prob.shape[1:]))])


class Model:
    """pieces x languages, and the bounded cache of scored words of a task."""

    def __init__(self, path: str, langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces_of(path), langs, with_zero(prob)
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table, self.letters = np.zeros((1024, len(self.langs))), np.zeros(1024, np.int64)

    def _learn(self, tokens: list[bytes]) -> None:
        """Rows of the cache for space-separated tokens: the sum over their words."""
        owners, words = [], []
        for t, b in enumerate(tokens):
            for w in letter_words(b.decode()):
                owners.append(t)
                words.append(w)
        first = len(self.place)
        need = first + len(tokens)
        if need > len(self.table):
            grown = max(need, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((grown - len(self.table), len(self.langs)))])
            self.letters = np.concatenate([self.letters, np.zeros(grown - len(self.letters), np.int64)])
        self.table[first:need], self.letters[first:need] = 0, 0
        owners = np.array(owners, np.int64) + first
        for ix in by_length(words).values():
            for s in range(0, len(ix), 20_000):
                part = ix[s:s + 20_000]
                np.add.at(self.table, owners[part], forward(self.pieces, [words[i] for i in part], self.prob))
        np.add.at(self.letters, owners, [len(w) - 1 for w in words])
        self.place.update(zip(tokens, range(first, need), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int]]:
        """(language, share, log-probability per letter, letters) of each text."""
        if len(self.place) > CACHE_ENTRIES:
            self._empty()
        tokens = [t.encode().lower().split() if t else [] for t in texts]
        self._learn(list(set().union(*tokens) - self.place.keys()))
        out = []
        for ts in tokens:
            at = np.fromiter(map(self.place.__getitem__, ts), np.int64, len(ts))
            letters = int(self.letters[at].sum())
            if not self.langs or not letters:
                out.append(("und", 0.0, None, letters))
                continue
            score = self.table[at].sum(axis=0)
            p = np.exp(score - score.max())
            best = int(np.argmax(score))
            out.append((self.langs[best], float(p[best] / p.sum()), float(score[best]) / letters, letters))
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, text) of at most ``per_lang`` training documents per language.
    The rank's limit is applied before the shuffle too, and the join reads
    the texts against ``per_lang`` ids a language."""
    keyed = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)).alias("h"))
    first = keyed.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = first.where(F.col("r") <= per_lang).select("lang", "h").distinct()
    return keyed.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_lang: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities pieces x languages)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            lang, word = [], []
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = letter_words(t)
                lang += [x] * len(ws)
                word += ws
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string())], ["lang", "word"])

    counted = cut(sample(docs, id_col, text_col, lang_col, per_lang).mapInArrow(split, "lang string, word string")
                  .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    size = len(pieces_of(vocab or public_tokenizers.path(VOCAB)).names)
    prob, last = np.full((size, len(langs)), 1 / size), -np.inf
    for _ in range(rounds if langs else 0):
        now = prob

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = pieces_of(vocab or public_tokenizers.path(VOCAB))
            full, sums, likelihood = with_zero(now), np.zeros((size + 1, len(langs))), 0.0
            for b in batches:
                lang, word, n = (b.column(i).to_pylist() for i in range(3))
                for at, name in enumerate(langs):
                    mine = [i for i, x in enumerate(lang) if x == name]
                    for ix in by_length([word[i] for i in mine]).values():
                        likelihood += expected(pieces, [word[mine[i]] for i in ix], np.array([n[mine[i]] for i in ix], float),
                                               full[:, at], sums[:, at])
            piece, at = np.nonzero(sums[:size])
            cols = np.r_[piece, -1], np.r_[at, -1], np.r_[sums[piece, at], likelihood]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["piece", "at", "n"])

        got = counted.mapInArrow(gather, "piece bigint, at bigint, n double").groupBy("piece", "at").agg(F.sum("n").alias("n"))
        prob, likelihood = np.full((size, len(langs)), PSEUDO), 0.0
        for r in got.collect():  # pieces x languages at most, and the likelihood
            if r.piece < 0:
                likelihood = r.n
            else:
                prob[r.piece, r["at"]] += r.n
        prob = prob / prob.sum(axis=0)
        if likelihood - last < GAIN * abs(likelihood):
            break
        last = likelihood
    return langs, prob


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: str | None = None,
            text_col: str = "text") -> DataFrame:
    """Rows (doc, lang_pred, score, fit, letters): ``doc`` holds the input's
    columns, ``fit`` the log-probability per letter in the predicted language
    (null for ``und``)."""
    langs, prob = model
    shared = docs.sparkSession.sparkContext.broadcast(prob)  # pieces x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(vocab or public_tokenizers.path(VOCAB), langs, shared.value)
        for b in slices(batches):
            got = m.predict(b.column(1).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]],
                                             ["doc", "lang_pred", "score", "fit", "letters"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("t"))
    return d.mapInArrow(run, f"doc {d.schema['doc'].dataType.simpleString()}, lang_pred string, score double, fit double, letters bigint")


#: A text of at least ``LETTERS_JUDGED`` letters is foreign when its fit is so many deviations below its language's training texts.
DEVIATIONS, LETTERS_JUDGED = 20.0, 60


def usual_fit(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: str | None = None, id_col: str = "doc_id",
              text_col: str = "text", lang_col: str = "lang", told: DataFrame | None = None) -> DataFrame:
    """(lang_pred, least): the fit below which a text is in no learned
    language, from the fits of all documents of the training folds; a row a
    language. ``told`` may pass the predictions of ``docs``."""
    told = predict(docs, model, vocab, text_col) if told is None else told
    told = told.where(~held_out(f"doc.`{id_col}`") & (F.col("lang_pred") == F.col(f"doc.`{lang_col}`")) & (F.col("letters") >= LETTERS_JUDGED))
    # a sixth of the texts are a deviation or more below the median; some odd ones change neither
    at = exact_quantiles(told.select("lang_pred", "fit"), "fit", [0.16, 0.5], ["lang_pred"])
    low, middle = (F.max(F.when(F.col("q_idx") == i, F.col("value"))) for i in (0, 1))
    return at.groupBy("lang_pred").agg((middle - DEVIATIONS * F.greatest(middle - low, F.lit(0.1))).alias("least"))


def in_learned_language(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows in a language that the training folds know: the share among the
    languages is ``min_score`` or more, and the text is not far less likely
    than that language's training texts are. All rows are predicted once; the
    predictions give the bounds and are then judged by them."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    told = cut(predict(docs, model, text_col=text_col))
    least = {r.lang_pred: r.least for r in usual_fit(docs, model, None, id_col, text_col, lang_col, told).collect()}  # a number a language
    bound = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])[F.col("lang_pred")] if least else F.lit(None)
    like = (F.col("letters") < LETTERS_JUDGED) | F.coalesce(F.col("fit") >= bound, F.lit(True))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score) & like).select("doc.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; languages are learned
    from the documents that are not held out and never read for a prediction."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    ids = docs.select(id_col, text_col)
    return predict(ids, model, text_col=text_col).select(
        F.col(f"doc.`{id_col}`").alias(id_col), held_out(f"doc.`{id_col}`").alias("held_out"), "lang_pred", "score")
