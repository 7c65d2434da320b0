"""Sum-of-squares packing of token sequences into fixed windows.

Every task packs the documents of its own partition, so nothing is shuffled
and a lost task is simply run again. A document's ids are cut into whole
windows while they last; the rest is placed online: ``level[h]`` counts the
open windows that are filled up to ``h``, and the rest goes to the level for
which the sum of the squared counts becomes smallest (an empty window is
level 0, a full one leaves the array). When the partition ends, or more than
``max_open`` windows are open, the open windows are settled: the emptiest are
taken apart and their pieces, cut where needed, fill the fullest. A partition
thus leaves one padded window at most.

Null texts are empty documents: they hold the end id alone. Repeated rows are
separate documents. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paircraft.llm.common import slices

VOCAB = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
#: Open windows of a task before they are settled (bounds its memory: a window's ids take 16 kB).
MAX_OPEN = 2048
#: Words that are encoded as one string, and words that a task remembers (about 200 MB).
JOINED, REMEMBERED = 150, 1_000_000
#: Texts that are encoded at a time: their words should stay in the processor's cache.
ENCODED = 32
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class WordBpe:
    """Ids of whole texts by the tokenizers library. The vocabulary drops white
    space and merges inside words only, so a text's ids are those of its
    space-separated parts in turn, and each distinct part is encoded once per
    task. Lower-casing A-Z first changes nothing but where it spells a special
    token, as the vocabulary does it and matches those in the text as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.ends_word = np.zeros(self.model.get_vocab_size(), bool)
        for piece, i in self.model.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}
        self._learn([b".", b","])
        self.mark = dict(self.cache)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Words of letters alone are encoded many to a string, as each of
        them ends with its first id that carries the word's end."""
        plain = [w for w in new if w.isalpha() or w.decode().isalpha()]
        ids = np.concatenate(self._encode([b" ".join(plain[i:i + JOINED]).decode() for i in range(0, len(plain), JOINED)]) or [np.empty(0, "<u4")])
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(ends) != len(plain):  # a letter that the vocabulary takes apart
            plain, ends = [], []
        raw = ids.tobytes()
        self.cache.update(zip(plain, [raw[a:z] for a, z in zip([0, *ends], ends)], strict=True))
        rest = [w for w in new if w not in self.cache]
        for w, x in zip(rest, self._encode([w.decode() for w in rest]), strict=True):
            self.cache[w] = x.tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        out: list[bytes] = []
        parts = []
        for t in texts:
            # a text that spells a special token, in any case, is encoded whole, without the cache
            raw = (t or "").encode()
            low = raw.lower()
            parts.append(None if any(a in raw or a in low for a in self.added) else low.split())
        # each word is looked up once; the few that are new are filled in
        words = list(chain.from_iterable(p for p in parts if p))
        ids = list(map(self.cache.get, words))
        at = [i for i, x in enumerate(ids) if x is None]
        new = {words[i] for i in at}
        # a full stop or comma after a letter is always a piece of its own
        ended = {w for w in new if w[-1] in b".," and w[-2:-1].isalpha()}
        self._learn(list(filterfalse(self.cache.__contains__, (new - ended).union(w[:-1] for w in ended))))
        for w in ended:
            self.cache[w] = self.cache[w[:-1]] + self.mark[w[-1:]]
        for i in at:
            ids[i] = self.cache[words[i]]
        begin = 0
        for t, p in zip(texts, parts, strict=True):
            end = begin + len(p or ())
            out.append(np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                       if p is None else b"".join(ids[begin:end]))
            begin = end
        return out


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> WordBpe:
    return WordBpe(path)


class Packer:
    """Online sum-of-squares packing of one partition. A piece is
    [doc_id, start, ids, doc_tokens]; ``done`` collects finished rows."""

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.level = np.zeros(window, np.int64)  # level[h]: open windows filled up to h; [0] stays 0
        self.open: dict[int, list[list]] = defaultdict(list)  # h -> windows, each a list of pieces
        self.next, self.done = first_sequence, []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self._close([[doc, start, ids[4 * start:4 * (start + self.window)], total]])
        if whole < total:
            self._place([doc, whole, ids[4 * whole:], total], total - whole)

    def _place(self, piece: list, size: int) -> None:
        """Change of the sum of squares by a move from level h to h + size:
        1 - 2 level[h] for the window that leaves, 1 + 2 level[h + size] for
        the one that arrives; a new window leaves no level, a full one joins none."""
        lv, room = self.level, self.window - size
        change = np.where(lv[:room + 1] > 0, 1 - 2 * lv[:room + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        change[:room] += 1 + 2 * lv[size:self.window]
        if room:
            h = int(np.argmin(change[::-1]))
            h = room - h  # the fullest of equal choices
        else:
            h = 0
        pieces = []
        if h:
            lv[h] -= 1
            pieces = self.open[h].pop()
        pieces.append(piece)
        if h + size == self.window:
            self._close(pieces)
            return
        lv[h + size] += 1
        self.open[h + size].append(pieces)
        if lv.sum() > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.level[:], self.open = 0, defaultdict(list)
        while left:
            pieces = left.pop(0)
            gap = self.window - sum(len(p[2]) // 4 for p in pieces)
            while gap and left:
                doc, start, ids, total = last = left[-1].pop()
                n = min(gap, len(ids) // 4)
                pieces.append([doc, start, ids[:4 * n], total])
                if 4 * n < len(ids):
                    last[1], last[2] = start + n, ids[4 * n:]
                    left[-1].append(last)
                elif not left[-1]:
                    left.pop()
                gap -= n
            self._close(pieces)

    def rows(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, vocab: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)
    of all documents in windows of ``window`` ids, the end id last in each
    document. Sequence ids are the partition's number times 2^40 and on."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocab or public_tokenizers.path(VOCAB))
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for b in slices(batches):
            for few in slices(iter([b]), ENCODED):
                for doc, ids in zip(few.column(0).to_pylist(), coder.encode_batch(few.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
            if packer.done:
                yield _batch(packer.rows())
        packer.settle()
        yield _batch(packer.rows())

    return docs.select(id_col, text_col).mapInArrow(run, PIECES)


def pad_to(length: int, window: int = WINDOW) -> int:
    """Length that a sequence is padded to: a power of two stays as it is, any
    other length is filled up to the window."""
    return length if length and length & (length - 1) == 0 else window
