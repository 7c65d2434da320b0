"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes that covers it also starts
earlier (in a document before, or earlier in the same one). So of the window
at each byte it must be known whether an equal window starts before it: its
longest previous factor, the longest prefix it has in common with any earlier
suffix, has ``length`` bytes.

One suffix array of the corpus would be one task's work, so suffixes are
parted first, such that equal windows meet:

1. Runs. A window's anchor is the smallest hash among its ``gram``-byte
   strings, the first such if there are more; neighbouring windows of one
   anchor are a run. Equal windows have equal anchors, at the same distance. Each block of texts keeps the first of its equal runs (the
   later ones are copies: all their windows go) and sends the others, packed,
   to the range of their anchor.
2. A range keeps the first of equal runs over all blocks, in the same way. An
   anchor that occurs once, or in equal runs only, is done. The first runs of
   other anchors differ from each other but may share windows: their texts
   are fetched and form regions of bounded size, whole anchors together.
3. A region's task sorts its suffixes by prefix doubling up to ``length``
   bytes, takes the longest common prefixes of neighbours, and finds for each
   suffix the previous and the next one in suffix order that has a smaller
   position. The longer of the two common prefixes is the longest previous
   factor.
4. An anchor with more runs than a region may hold is parted again by longer
   anchors, at last by whole windows, where equal windows are equal runs.

Documents are ordered by id (null first), and by crc32 of their text where ids
repeat; rows equal in both are one document and get the same result. Null
texts count as empty; texts shorter than ``length`` stay whole. An empty table
gives no rows. Other columns are ignored. Hashes have 64 bits within an anchor
of 32 bits and its range; regions compare bytes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut, mix, n_parts, slices

LENGTH = 100
#: Bytes of an anchor, by level.
GRAMS = (32, 64, 84, LENGTH)
#: Bytes of text hashed at once and of a block; runs of a region, about.
CHUNK, BLOCK_BYTES, REGION_RUNS = 1 << 20, 16 << 20, 8192
#: Bytes of fetched text that a task holds before it passes them on.
HELD_BYTES = 16 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_PRIME, _STEP = 1_000_003, 7919
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[n] = tuple(both)
    return _POWERS[n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    n = len(x) - width + 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def runs(texts: list[bytes], gram: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, hash) of the runs of some texts of
    ``length`` bytes or more, about ``CHUNK`` bytes in all."""
    sizes = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    up, down = (p[:len(a) + 1] for p in powers(max(CHUNK + length, len(a) + 1)))
    s = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:-1], out=s[1:])
    grams = mix((s[gram:] - s[:-gram]) * down[:len(a) - gram + 1])
    low = sliding_min(grams, length - gram + 1)
    begin = np.cumsum(sizes) - sizes
    able = np.zeros(len(low) + 1, np.int8)
    able[begin] += 1
    able[begin[1:] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(able[:-1], dtype=np.int8))
    value = low[at]
    # the windows of a run have the same first place of the smallest hash, so that no two of them are equal
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (grams[at[:-1]] == value[:-1])]
    first = np.flatnonzero(new)
    start, n = at[first], np.diff(np.r_[first, len(at)])
    code = mix((s[start + n + length - 1] - s[start]) * down[start] + n.astype(np.uint64))
    text = np.searchsorted(begin, start, "right") - 1
    return text, start - begin[text], n, value[first], code


def cut_text(text: bytes, size: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, part) such that each window is in one part."""
    for i in range(0, max(len(text) - length + 1, 1), size):
        yield i, text[i:i + size + length - 1]


def all_runs(texts: list[tuple[int, int, bytes]], gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(owner, start, windows, anchor, hash) of (owner, offset, text), in order."""
    found, group, held = [], [], 0

    def flush() -> None:
        if group:
            text, start, *rest = runs([g[2] for g in group], gram, length)
            owner, offset = (np.array([g[i] for g in group], np.int64)[text] for i in (0, 1))
            found.append((owner, start + offset, *rest))

    for owner, offset, text in texts:
        if len(text) >= length:
            for i, part in cut_text(text, CHUNK, length):
                if held + len(part) > CHUNK:
                    flush()
                    group, held = [], 0
                group.append((owner, offset + i, part))
                held += len(part)
    flush()
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---------------------------------------------------------------- packed spans
#: Documents (id, tie) with so many spans each; spans as offset and number of windows.
SPANS = "ids binary, ties binary, counts binary, offsets binary, sizes binary"
PACKED = f"dest int, kind int, region bigint, {SPANS}, anchors binary, codes binary, texts binary"
LOST, FETCH, FIRST, MORE, TEXT = range(5)
_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def packed(dest: int, kind: int, region: int, ids: np.ndarray, ties: np.ndarray, offsets: np.ndarray, sizes: np.ndarray,
           anchors: np.ndarray | None = None, codes: np.ndarray | None = None, texts: bytes | None = None) -> tuple:
    """A row of spans that are in order of their documents."""
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])
    counts = np.diff(np.r_[new, len(ids)])
    as_bytes = lambda x, t: None if x is None else x.astype(t).tobytes()
    return (dest, kind, region, as_bytes(ids[new], "<i8"), as_bytes(ties[new], "<u4"), as_bytes(counts, "<u4"), as_bytes(offsets, "<u4"),
            as_bytes(sizes, "<u2"), as_bytes(anchors, "<u4"), as_bytes(codes, "<u8"), texts)


def unpacked(r: dict) -> tuple[np.ndarray, ...]:
    """(id, tie, offset, windows) of a row's spans."""
    counts = np.frombuffer(r["counts"], "<u4")
    return (np.repeat(np.frombuffer(r["ids"], "<i8"), counts), np.repeat(np.frombuffer(r["ties"], "<u4").astype(np.int64), counts),
            np.frombuffer(r["offsets"], "<u4").astype(np.int64), np.frombuffer(r["sizes"], "<u2").astype(np.int64))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def batches_of(rows: Iterator[tuple], most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def home(ids: np.ndarray, ties: np.ndarray, homes: int) -> np.ndarray:
    """The part that a document's text is dealt to; ``home_column`` is the same."""
    return (ids % _PRIME * _STEP + ties) % _PRIME % homes


def home_column(homes: int) -> Column:
    return F.pmod(F.pmod("id", F.lit(_PRIME)) * _STEP + F.col("tie"), F.lit(_PRIME)) % homes


def by_home(kind: int, region: int, homes: int, ids: np.ndarray, ties: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Rows of spans for each home, in order of their documents."""
    if not len(ids):
        return
    at = home(ids, ties, homes)
    order = np.lexsort((offsets, ties, ids, at))
    at = at[order]
    for part in np.split(order, np.flatnonzero(at[1:] != at[:-1]) + 1):
        yield packed(int(home(ids[part[:1]], ties[part[:1]], homes)[0]), kind, region, ids[part], ties[part], offsets[part], sizes[part])


def text_parts(text: bytes, starts: np.ndarray, sizes: np.ndarray, length: int) -> list[bytes]:
    return [text[s:s + n + length - 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# ---------------------------------------------------------------- runs of blocks, first of each
def first_of_block(texts: list[tuple[int, int, int, bytes]], gram: int, length: int, ranges: int, homes: int, with_text: bool) -> Iterator[tuple]:
    """Rows of the first runs of a block of (id, tie, offset, text) by range of
    their anchor, and of the later ones of equal runs by home."""
    texts.sort(key=lambda t: t[:3])
    owner, offset, n, anchor, code = all_runs([(i, t[2], t[3]) for i, t in enumerate(texts)], gram, length)
    if not len(owner):
        return
    ids, ties = (np.array([t[i] for t in texts], np.int64)[owner] for i in (0, 1))
    # a stable sort: equal runs stay in order of their positions
    order = np.argsort(code, kind="stable")
    o = order[1:]
    same = (code[o] == code[order[:-1]]) & (anchor[o] == anchor[order[:-1]])
    lead = order[np.maximum.accumulate(np.where(np.r_[False, same], 0, np.arange(len(order))))]
    again = (ids[order] == ids[lead]) & (ties[order] == ties[lead]) & (offset[order] == offset[lead])
    lost = np.sort(order[np.r_[False, same] & ~again])
    yield from by_home(LOST, -1, homes, ids[lost], ties[lost], offset[lost], n[lost])
    kept = np.sort(order[~np.r_[False, same]])
    shard = ((anchor[kept] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
    sorting = np.argsort(shard, kind="stable")
    shard, kept = shard[sorting], kept[sorting]
    for part in np.split(kept, np.flatnonzero(shard[1:] != shard[:-1]) + 1):
        words = None
        if with_text:
            words = b"".join(texts[w][3][s - texts[w][2]:s - texts[w][2] + k + length - 1]
                             for w, s, k in zip(owner[part].tolist(), offset[part].tolist(), n[part].tolist(), strict=True))
        yield packed(int(anchor[part[0]] >> np.uint64(32)) % ranges, FIRST, -1, ids[part], ties[part], offset[part], n[part], anchor[part],
                     code[part], words)


def documents_runs(docs: DataFrame, length: int, gram: int, ranges: int, homes: int) -> DataFrame:
    """Rows of ``first_of_block`` of (id, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            block, held = [], 0
            for b in slices(batches):
                for i, tie, text in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                    block.append((i, tie, 0, text.encode()))
                    held += len(text)
                    if held >= BLOCK_BYTES:
                        yield from first_of_block(block, gram, length, ranges, homes, False)
                        block, held = [], 0
            yield from first_of_block(block, gram, length, ranges, homes, False)
        yield from batches_of(rows())

    return docs.select("id", "tie", "text").mapInArrow(run, PACKED)


def pieces_of(r: dict, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(id, tie, offset, windows, text) of a row with texts."""
    at, text = 0, r["texts"]
    for i, tie, s, n in zip(*(x.tolist() for x in unpacked(r)), strict=True):
        yield i, tie, s, n, text[at:at + n + length - 1]
        at += n + length - 1


def pieces_runs(pieces: DataFrame, length: int, gram: int, ranges: int, homes: int) -> DataFrame:
    """Rows of ``first_of_block`` of packed pieces, with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            block, held = [], 0
            for r in one_by_one(batches):
                block.extend((i, tie, s, text) for i, tie, s, _, text in pieces_of(r, length))
                held += len(r["texts"])
                if held >= BLOCK_BYTES:
                    yield from first_of_block(block, gram, length, ranges, homes, True)
                    block, held = [], 0
            yield from first_of_block(block, gram, length, ranges, homes, True)
        yield from batches_of(rows())

    return pieces.mapInArrow(run, PACKED)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def first_of_range(rows: DataFrame, length: int, ranges: int, homes: int, last: bool, with_text: bool) -> DataFrame:
    """Rows of all lost spans by home, and of the runs that are left to
    compare: FETCH by home (or, with texts, by region), MORE where an anchor has
    too many."""
    most = REGION_RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            parts, words, shard = [], [], 0
            for r in one_by_one(batches):
                if r["kind"] == LOST:
                    yield tuple(r[c] for c in _NAMES)
                    continue
                shard = r["dest"]
                parts.append((*unpacked(r), np.frombuffer(r["anchors"], "<u4"), np.frombuffer(r["codes"], "<u8")))
                if with_text:
                    words.extend(p[4] for p in pieces_of(r, length))
            if not parts:
                return
            ids, ties, offset, n, anchor, code = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(anchor, kind="stable")
            many = np.r_[False, anchor[order[1:]] == anchor[order[:-1]]]
            order = order[many | np.r_[many[1:], False]]  # an anchor that occurs once is done
            order = order[np.lexsort((offset[order], ties[order], ids[order], code[order], anchor[order]))]
            o, before = order[1:], order[:-1]
            same = np.r_[False, (code[o] == code[before]) & (anchor[o] == anchor[before])][:len(order)]
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            again = (ids[order] == ids[lead]) & (ties[order] == ties[lead]) & (offset[order] == offset[lead])
            lost = order[same & ~again]
            yield from by_home(LOST, -1, homes, ids[lost], ties[lost], offset[lost], n[lost])
            firsts = order[~same]
            new = np.flatnonzero(np.r_[True, anchor[firsts[1:]] != anchor[firsts[:-1]]][:len(firsts)])
            count = np.diff(np.r_[new, len(firsts)])
            size = np.repeat(count, count)
            large = size > (most if not last else len(firsts))
            fit = (size > 1) & ~large
            # whole anchors fill the regions one after the other
            region = np.cumsum(np.where(fit, 1, 0))
            region = np.repeat(region[new] // most if len(new) else region[:0], count)
            todo = [(FETCH, firsts[fit], region[fit]), (MORE, firsts[large], np.zeros(int(large.sum()), np.int64))]
            for kind, chosen, regions in todo:
                for g in np.unique(regions).tolist():
                    mine = chosen[regions == g]
                    where = shard << 20 | g
                    if not with_text:
                        yield from by_home(kind, where, homes, ids[mine], ties[mine], offset[mine], n[mine])
                    else:
                        yield packed(shard, kind, where, ids[mine], ties[mine], offset[mine], n[mine], None, None,
                                     b"".join(words[i] for i in mine.tolist()))
        yield from batches_of(out())

    return rows.repartitionById(ranges, F.pmod("dest", F.lit(ranges))).mapInArrow(run, PACKED)


# ---------------------------------------------------------------- texts at their homes
def at_home(docs: DataFrame, spans: DataFrame, homes: int) -> DataFrame:
    """The rows of each home's spans (kind, region, ...), then its texts."""
    texts = docs.select(home_column(homes).cast("int").alias("dest"), F.lit(TEXT).alias("kind"), "id", "tie", "text", "doc_id")
    both = spans.drop("anchors", "codes", "texts").unionByName(texts, allowMissingColumns=True)
    return both.repartitionById(homes, F.col("dest")).sortWithinPartitions("kind")


def fetched(docs: DataFrame, wanted: DataFrame, homes: int, length: int) -> DataFrame:
    """Rows of the wanted spans with their texts, by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple, list] = defaultdict(list)
        ready: dict[tuple, list] = defaultdict(list)
        held = 0

        def rows() -> Iterator[tuple]:
            for (kind, region), found in ready.items():
                cols = [np.array(x, np.int64) for x in zip(*(f[:4] for f in found), strict=True)]
                yield packed(region >> 20, kind, region, *cols, None, None, b"".join(f[4] for f in found))
            ready.clear()

        for b in slices(batches):
            for r in b.to_pylist():
                if r["kind"] != TEXT:
                    for i, tie, s, n in zip(*(x.tolist() for x in unpacked(r)), strict=True):
                        spans[i, tie].append((r["kind"], r["region"], s, n))
                    continue
                # of equal rows the first one serves
                mine = spans.pop((r["id"], r["tie"]), None)
                if mine:
                    text = r["text"].encode()
                    for kind, region, s, n in mine:
                        ready[kind, region].append((r["id"], r["tie"], s, n, text[s:s + n + length - 1]))
                        held += n + length
                    if held > HELD_BYTES:
                        yield from batches_of(rows())
                        held = 0
        yield from batches_of(rows())

    return at_home(docs, wanted, homes).mapInArrow(run, PACKED)


# ---------------------------------------------------------------- suffix order of a region
def rank_pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, in suffix order, with the nearest one
    before it that has a smaller position (0: none). ``lcp``: with the
    neighbour before. Pointers jump over suffixes of larger positions."""
    to = np.arange(-1, len(position) - 1)
    common = lcp.copy()
    act = np.flatnonzero(to >= 0)
    while len(act):
        act = act[position[to[act]] > position[act]]
        via = to[act]
        common[act], to[act] = np.minimum(common[act], common[via]), to[via]
        act = act[to[act] >= 0]
    common[to < 0] = 0
    return common


def longest_previous(text: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Longest previous factor, up to ``length``, of the suffixes at ``starts``,
    which are in order of their positions."""
    n = len(text)
    a = np.zeros(n + 2 * length + 8, np.uint64)
    a[:n] = np.frombuffer(text, np.uint8)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= a[j:n + j] << np.uint64(56 - 8 * j)
    ranks, width = {8: np.unique(key, return_inverse=True)[1].astype(np.int64) + 1}, 8
    pad = lambda r: np.r_[r, np.zeros(2 * length, np.int64)]
    ranks[8] = pad(ranks[8])
    while width * 2 <= length:
        r = ranks[width]
        ranks[2 * width] = pad(rank_pairs(r[:n], r[width:width + n]) + 1)
        width *= 2
    r = ranks[width]
    # equal prefixes stay in order of their positions
    key = r[starts] * (n + 2) + r[starts + length - width]
    order = np.argsort(key, kind="stable")
    p, q = starts[order[:-1]], starts[order[1:]]
    lcp = np.zeros(len(p), np.int64)
    while width >= 8:
        lcp += np.where((lcp + width <= length) & (ranks[width][p + lcp] == ranks[width][q + lcp]), width, 0)
        width //= 2
    for _ in range(7):
        lcp += (lcp < length) & (a[p + lcp] == a[q + lcp])
    lcp = np.maximum(lcp, np.where(key[order[:-1]] == key[order[1:]], length, 0))
    back = previous_smaller(order, np.r_[0, lcp][:len(order)])
    ahead = previous_smaller(order[::-1], np.r_[0, lcp[::-1]][:len(order)])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(back, ahead)
    return out


def lost_in_region(pieces: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """(id, tie, offset, windows) of the windows of (id, tie, offset, windows,
    text) that start earlier too."""
    pieces.sort(key=lambda p: p[:3])
    ids, ties, offset, n = (np.array(x, np.int64) for x in zip(*(p[:4] for p in pieces), strict=True))
    begin = np.cumsum(n + length - 1) - (n + length - 1)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    lost = np.flatnonzero(longest_previous(b"".join(p[4] for p in pieces), begin[which] + inside, length) >= length)
    which, inside = which[lost], inside[lost]
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (inside[1:] != inside[:-1] + 1)][:len(lost)])
    return ids[which[new]], ties[which[new]], (offset[which] + inside)[new], np.diff(np.r_[new, len(lost)])


def compared(pieces: DataFrame, length: int, homes: int, parts: int) -> DataFrame:
    """Rows of the lost spans of all regions, by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, group = None, []
            for r in one_by_one(batches):
                if r["region"] != now and group:
                    yield from by_home(LOST, -1, homes, *lost_in_region(group, length))
                    group = []
                now = r["region"]
                group.extend(pieces_of(r, length))
            if group:
                yield from by_home(LOST, -1, homes, *lost_in_region(group, length))
        yield from batches_of(rows())

    dealt = pieces.repartitionById(parts, F.pmod(F.xxhash64("region"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("region").mapInArrow(run, PACKED)


# ---------------------------------------------------------------- documents
def covered(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows, from spans in order of their starts."""
    ends = np.maximum.accumulate(starts + sizes + length - 1)
    new = np.r_[True, starts[1:] > ends[:-1]]
    return list(zip(starts[new].tolist(), ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]].tolist(), strict=True))


def without(docs: DataFrame, lost: DataFrame, homes: int, length: int) -> DataFrame:
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, spans = [], None

        def table() -> dict:
            if not parts:
                return {}
            ids, ties, offset, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((offset, ties, ids))
            ids, ties, offset, n = ids[order], ties[order], offset[order], n[order]
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])
            return {(int(ids[s]), int(ties[s])): (offset[s:e], n[s:e]) for s, e in zip(new, np.r_[new[1:], len(ids)], strict=True)}

        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                if r["kind"] != TEXT:
                    parts.append(unpacked(r))
                    continue
                if spans is None:
                    spans = table()
                    parts.clear()
                text, mine = r["text"].encode(), spans.get((r["id"], r["tie"]))
                cuts = covered(*mine, length) if mine else []
                at, kept = 0, []
                for s, e in cuts:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                out.append((r["doc_id"], len(text), [{"start": s, "end": e} for s, e in cuts], b"".join(kept)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), span, pa.binary()),
                                                                                 strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    return at_home(docs, lost, homes).mapInArrow(run, schema)


def dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: maximal removed runs of
    bytes (start, end) and the bytes that stay."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), F.crc32("text").alias("tie"), "text")
    homes = n_parts(docs)
    ranges = 2 * homes
    found = cut(documents_runs(rows, length, grams[0], ranges, homes).transform(first_of_range, length, ranges, homes, len(grams) == 1, False))
    lost = [found.where(F.col("kind") == LOST)]
    wanted = found.where(F.col("kind") != LOST)
    pieces = cut(fetched(rows, wanted, homes, length))
    for k, gram in enumerate(grams[1:], start=2):
        lost.append(compared(pieces.where(F.col("kind") == FETCH), length, homes, ranges))
        pieces = pieces.where(F.col("kind") == MORE)
        if pieces.isEmpty():
            break
        pieces = cut(pieces_runs(pieces, length, gram, ranges, homes).transform(first_of_range, length, ranges, homes, k == len(grams), True))
        lost.append(pieces.where(F.col("kind") == LOST))
    else:
        lost.append(compared(pieces.where(F.col("kind") == FETCH), length, homes, ranges))
    spans = lost[0]
    for more in lost[1:]:
        spans = spans.unionByName(more)
    return without(rows, spans, homes, length)


def report(docs: DataFrame) -> DataFrame:
    """``dedup`` with the spans counted and the kept bytes as a digest."""
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return dedup(docs).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                              F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """``report`` as DuckDB SQL over hexadecimal texts: every window by its string."""
    n = LENGTH
    return f"""WITH _d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
_w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1})) AS i FROM _d)),
_f AS (SELECT w, min({{'doc': doc_id, 'i': i}}) AS first FROM _w GROUP BY w HAVING count(*) > 1),
_g AS (SELECT doc_id, i FROM _w JOIN _f USING (w) WHERE doc_id <> first.doc OR i <> first.i),
_s AS (SELECT doc_id, i, sum(CASE WHEN i - before <= {n} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM _g)),
_r AS (SELECT doc_id, span, min(i) AS lo, max(i) + {n} AS hi FROM _s GROUP BY doc_id, span),
_k AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM _r GROUP BY doc_id),
_e AS (SELECT doc_id, h, coalesce(los, []) AS los, coalesce(his, []) AS his FROM _d LEFT JOIN _k USING (doc_id))
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(his) - list_sum(los), 0) AS BIGINT) AS n_removed,
  CAST(len(los) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string([substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))
    FOR z IN list_zip(list_prepend(0, his), list_append(los, len(h) // 2))], ''))) AS kept_sha256
FROM _e"""
