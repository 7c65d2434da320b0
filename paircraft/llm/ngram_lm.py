"""Language-model scores by interpolated n-gram backoff.

Tokens are words (runs ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end
token per text. The n-grams of the training texts are smoothed by a Dirichlet
prior on the next lower order,

    p(w | h) = (c(h w) + MU p(w | h')) / (c(h) + MU),

h' being h without its first word; the lowest order discounts known words by
``DISCOUNT`` and gives the mass to one class of unknown words. A weighted
backoff automaton has these probabilities: its states are the histories that
training texts hold, an arc weighs log10 p(w | h) of an n-gram that they hold,
and a failure arc, which weighs log10 (MU / (c(h) + MU)), leads to h'. Each text
is read once from left to right, carrying the state and adding up weights.

The table of n-grams grows with the corpus and is nowhere whole. Each block of
documents sends its distinct n-grams, with their training counts, to hash
ranges; a range's task adds up the counts of all blocks and answers each block
with the totals of its own n-grams, from which the block builds the part of the
automaton that its texts can reach. A
frequent n-gram is one number per block, so no range is hot. Unigrams are told apart by 64-bit
hashes, longer n-grams by 32 bits and their range (of 2^32 unseen n-grams in a
range one in 1,000 is taken for a seen one per 4 million).

The blocks are those of the scan, so ``docs`` must be a table that reads the
same twice; a digest of each block is compared and a difference raises.

Null and empty texts are the end token alone. Without training texts every
probability is 1 (score 0). Repeated rows count each; a null id counts as
training; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import WordCodes, cut, mix, n_parts, slices, word_crc, words

ORDER, MU, DISCOUNT = 2, 4.0, 0.75
#: Documents and tokens of a block, at most (one longer text is a block of its own).
BLOCK_DOCS, BLOCK_TOKENS = 2048, 600_000
#: Tokens that are read in one go; longer texts are read in stretches side by side.
STRETCH = 512
#: Tasks that score the blocks of one partition of the scan.
DEALT = 8
END, PAD = np.uint64(1), np.uint64(2)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(word_crc(id_col) % 7 == 2, F.lit(False))


class Block:
    """Tokens of some documents in a row and their n-grams' hashes."""

    def __init__(self, codes: list[np.ndarray], training: list[bool], order: int):
        self.lengths = np.array([len(c) + 1 for c in codes])
        self.ends = np.cumsum(self.lengths)
        self.tokens = np.full(self.ends[-1], END)
        inside = np.ones(len(self.tokens), bool)
        inside[self.ends - 1] = False
        self.tokens[inside] = np.concatenate(codes)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.ends - self.lengths] = True
        self.training = np.repeat(np.array(training, bool), self.lengths)
        # grams[k]: hash of the (k + 1)-gram that ends at each token; texts begin after padding
        self.grams, back = [self.tokens], self.tokens
        for _ in range(1, order):
            back = self.shifted(back, PAD)
            self.grams.append(mix(self.grams[-1] * _PRIME ^ back))

    def shifted(self, values: np.ndarray, before) -> np.ndarray:
        """The previous token's value, ``before`` at a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = before
        return out

    def digest(self) -> int:
        return zlib.crc32(self.lengths.tobytes(), zlib.crc32(self.tokens[::97].tobytes()))


def blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, list, list, list, Block]]:
    """(number, ids, held_out flags, texts, block) of a partition of (id, text, held_out), in order."""
    codes, name = WordCodes(), TaskContext.get().partitionId() << 20
    ids, held, raw, texts, n = [], [], [], [], 0
    for b in slices(batches):
        for doc, text, out in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            ids.append(doc)
            held.append(out)
            raw.append(text)
            texts.append(codes.of(words(text)))
            n += len(texts[-1]) + 1
            if len(ids) >= BLOCK_DOCS or n >= BLOCK_TOKENS:
                yield name, ids, held, raw, Block(texts, [not h for h in held], order)
                ids, held, raw, texts, n, name = [], [], [], [], 0, name + 1
    if ids:
        yield name, ids, held, raw, Block(texts, [not h for h in held], order)


def distinct(grams: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, at, dealt, ends): distinct hashes, each token's place among them,
    their order by hash range, and where each range ends in it."""
    keys, at = np.unique(grams, return_inverse=True)
    part = (keys >> np.uint64(33)) % np.uint64(ranges)
    dealt = np.argsort(part, kind="stable")
    return keys, at, dealt, np.searchsorted(part[dealt], np.arange(ranges + 1))


def ask(docs: DataFrame, order: int, ranges: int) -> DataFrame:
    """(block, digest, k, part, keys, counts): a block's distinct n-grams of
    length k + 1 in a hash range, in order, and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, block in blocks(batches, order):
            rows, digest = [], block.digest()
            for k, grams in enumerate(block.grams):
                keys, at, dealt, ends = distinct(grams, ranges)
                counts = np.bincount(at[block.training], minlength=len(keys))[dealt].astype("<u4")
                sent = keys[dealt].astype("<u8" if k == 0 else "<u4")
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    s = slice(ends[p], ends[p + 1])
                    rows.append((name, digest, k, p + k * ranges, sent[s].tobytes(), zlib.compress(counts[s].tobytes(), 1)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["block", "digest", "k", "part", "keys", "counts"])

    return docs.mapInArrow(run, "block bigint, digest bigint, k int, part int, keys binary, counts binary")


def answer(asked: DataFrame, order: int, ranges: int) -> DataFrame:
    """(block, digest, k, part, data, n, v): the corpus-wide training counts of
    a block's n-grams in a range. A range's first row also has its sums: n
    training tokens and v distinct ones (unigrams only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, counts = [], [], []
        for b in batches:
            for block, digest, k, part, key, count in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                rows.append((block, digest, k, part))
                keys.append(np.frombuffer(key, "<u8" if k == 0 else "<u4"))
                counts.append(np.frombuffer(zlib.decompress(count), "<u4"))
        if not rows:
            return
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(known)).astype("<i8")
        ends = np.cumsum([len(k) for k in keys])
        for i, (block, digest, k, part) in enumerate(rows):
            mine = total[at[ends[i] - len(keys[i]):ends[i]]]
            first = k == 0 and i == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([digest]), pa.array([k], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([zlib.compress(mine.tobytes(), 1)]), pa.array([int(total.sum()) if first else 0]),
                 pa.array([int((total > 0).sum()) if first else 0])], ["block", "digest", "k", "part", "data", "n", "v"])

    dealt = asked.repartitionById(order * ranges, F.col("part"))
    return dealt.mapInArrow(run, "block bigint, digest bigint, k int, part int, data binary, n bigint, v bigint")


class Automaton:
    """The weighted backoff automaton of a block's n-grams.

    A state is a history that training texts hold (state 0: the empty one; the
    last states: what stands before a text). ``arc_key`` has an arc's state and
    token in one number, in order; ``arc_weight`` its log10 probability and
    ``arc_target`` the state of the longest known history that it leads to. A
    state without an arc for a token is left by its failure arc, at
    ``fail_weight``, to ``fail_target``, the history without its first word. The
    empty history has an arc for every token."""

    def __init__(self, block: Block, totals: list[np.ndarray], at: list[np.ndarray], n: int, v: int, texts: int, mu: float, discount: float):
        """totals[k]: training counts of the block's distinct (k + 1)-grams;
        at[k]: the place among them of the one that ends at each token; texts:
        training texts, the count of the states before a text's first token."""
        order, self.words = len(totals), len(totals[0])
        c = totals[0]
        p = np.where(c > 0, (c - discount) / max(n, 1), discount * v / max(n, 1)) if n else np.ones(len(c))
        first_state = np.cumsum([1, *[len(t) for t in totals[:-1]]])  # of the histories of length k + 1
        self.start = int(first_state[-1]) - 1  # plus k: the state of k words of padding
        states = self.start + order
        self.fail_target, count = np.zeros(states, np.int64), np.zeros(states)
        for k in range(1, order):
            self.fail_target[self.start + k] = self.start + k - 1 if k > 1 else 0
            count[self.start + k] = texts
        key, weight, target, shorter = [], [], [], None
        for k, total in enumerate(totals):
            token = np.empty(len(total), np.int64)  # one at which the gram ends
            token[at[k][::-1]] = np.arange(len(at[k]))[::-1]
            seen = total > 0
            lower = at[k - 1][token] if k else None
            if k:
                text_start = block.first[token]
                state = np.where(text_start, self.start + k, first_state[k - 1] + at[k - 1][token - 1])
                p = (total + mu * p[lower]) / (np.where(text_start, texts, totals[k - 1][at[k - 1][token - 1]]) + mu)
            else:
                state = np.zeros(len(total), np.int64)
            if k < order - 1:
                # the longest known history at the end of each gram
                known = np.where(seen, first_state[k] + np.arange(len(total)), shorter[lower] if k else 0)
                mine = slice(first_state[k], first_state[k] + len(total))
                count[mine], self.fail_target[mine] = total, shorter[lower] if k else 0
            else:
                known = shorter[lower] if k else np.zeros(len(total), np.int64)
            arcs = seen if k else np.ones(len(total), bool)
            key.append((state * self.words + at[0][token])[arcs])
            weight.append(np.log10(p)[arcs])
            target.append(known[arcs])
            shorter = known
        self.fail_weight = np.log10(mu / (count + mu))
        order_of = np.argsort(key := np.concatenate(key), kind="stable")
        self.arc_key, self.arc_weight, self.arc_target = key[order_of], np.concatenate(weight)[order_of], np.concatenate(target)[order_of]
        self.order = order

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 weights) of reading one token in each state."""
        out, total, todo = np.empty_like(state), np.zeros(len(state)), np.arange(len(state))
        state = state.copy()
        while len(todo):
            want = state[todo] * self.words + token[todo]
            arc = np.minimum(np.searchsorted(self.arc_key, want), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == want
            done, arc = todo[hit], arc[hit]
            out[done] = self.arc_target[arc]
            total[done] += self.arc_weight[arc]
            todo = todo[~hit]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail_target[state[todo]]
        return out, total

    def traverse(self, block: Block, tokens: np.ndarray, stretch: int) -> np.ndarray:
        """log10 p of every token. All texts are read left to right side by
        side, each carrying its state. A text of more than ``stretch`` tokens is
        read in stretches; a later one begins ``order`` - 1 tokens early, from
        the empty history, which leaves it in the state of the text so far."""
        begin = block.ends - block.lengths
        count = -(-block.lengths // stretch)
        text = np.repeat(np.arange(len(begin)), count)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stretch
        early = np.where(place > 0, self.order - 1, 0)
        from_ = begin[text] + place - early
        size = np.minimum(stretch, block.lengths[text] - place) + early
        longest = np.argsort(-size, kind="stable")
        from_, size, early = from_[longest], size[longest], early[longest]
        state = np.where(early == 0, self.start + self.order - 1 if self.order > 1 else 0, 0)
        state[place[longest] > 0] = 0
        logs = np.zeros(len(tokens))
        for t in range(int(size[0])):
            on = int(np.searchsorted(-size, -t, "left"))  # those with more than t tokens
            state[:on], weight = self.step(state[:on], tokens[from_[:on] + t])
            told = t >= early[:on]
            logs[from_[:on][told] + t] = weight[told]
        return logs


def scores(docs: DataFrame, order: int = ORDER, mu: float = MU, discount: float = DISCOUNT, id_col: str = "doc_id",
           text_col: str = "text", out_of_training: Callable[[str], Column] = held_out) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the automaton's log10 probability)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                    out_of_training(id_col).alias("held_out"))
    ranges = n_parts(docs)
    answers = cut(answer(ask(d, order, ranges), order, ranges))
    n, v = answers.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    texts = d.where(~F.col("held_out")).count()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts again, under their block's number."""
        for name, ids, held, raw, _ in blocks(batches, order):
            for i in range(0, len(ids), 64):
                s = slice(i, i + 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([-1], pa.int32()), pa.array([i], pa.int32()),
                     pa.array([ids[s]], pa.list_(pa.int64())), pa.array([held[s]], pa.list_(pa.bool_())),
                     pa.array([raw[s]], pa.list_(pa.string()))], ["block", "k", "part", "ids", "held", "texts"])

    sent = d.mapInArrow(send, "block bigint, k int, part int, ids array<bigint>, held array<boolean>, texts array<string>")
    both = sent.unionByName(answers.select("block", "k", "part", "digest", "data"), allowMissingColumns=True)
    # the blocks of a partition of the scan are dealt one by one, so that tasks have even shares
    home = (F.shiftright("block", 20) * DEALT + F.col("block") % DEALT).cast("int")
    both = both.repartitionById(ranges * DEALT, home).sortWithinPartitions("block", "k", "part").select(
        "block", "k", "ids", "held", "texts", "digest", "data")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(ids: list, held: list, raw: list, told: list, codes: WordCodes) -> pa.RecordBatch:
        block = Block([codes.of(words(t)) for t in raw], [not h for h in held], order)
        if {x[1] for x in told} != {block.digest()}:
            raise RuntimeError("the input did not read the same twice; write it to a table first")
        totals, at = [], []
        for k, grams in enumerate(block.grams):
            keys, place, dealt, _ = distinct(grams, ranges)
            total = np.empty(len(keys), np.int64)
            total[dealt] = np.concatenate([np.frombuffer(zlib.decompress(x[2]), "<i8") for x in told if x[0] == k])
            totals.append(total)
            at.append(place)
        begin = block.ends - block.lengths
        c = totals[0][at[0]]
        logs = Automaton(block, totals, at, n, v, texts, mu, discount).traverse(block, at[0], STRETCH)
        base = np.log10((c + 1) / (n + v + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held), pa.array(block.lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)),
             pa.array([n] * len(ids), pa.int64()), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(logs, begin))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, now = WordCodes(), None
        ids, held, raw, told = [], [], [], []
        for b in slices(batches):
            for name, k, i, h, t, digest, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now and now is not None:
                    yield finish(ids, held, raw, told, codes)
                    ids, held, raw, told = [], [], [], []
                now = name
                if k < 0:
                    ids += i
                    held += h
                    raw += t
                else:
                    told.append((k, digest, data))
        if now is not None:
            yield finish(ids, held, raw, told, codes)

    out = both.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                               "base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
