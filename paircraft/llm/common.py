"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paircraft.session import ensure_checkpoint_dir, shuffle_partitions

#: Entries that a task's word cache may hold before it is emptied (bounds a worker's memory).
CACHE_ENTRIES = 300_000
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def n_parts(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``: as many as the scan has, at least
    the session's setting, so that a partition's share stays the same as the
    input grows."""
    return max(shuffle_partitions(df.sparkSession), df.rdd.getNumPartitions())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8
    (``bytes.split`` cuts at exactly these characters)."""
    return text.encode().lower().split() if text else []


def word_crc(col: str) -> Column:
    """crc32 of an id written as text, the fold rule of the held-out splits."""
    return F.crc32(F.col(col).cast("string"))


class WordCodes(dict):
    """word -> 64-bit hash, computed once per task and word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


#: Odd multipliers that make a shingle's hash depend on word order, and of the final mix.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                   0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(codes: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hashes of the ``width``-word shingles in text order; a shorter
    text is one shingle, no words are none."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(n, width)
    h = np.zeros(n - w + 1, np.uint64)
    for i in range(w):
        h += codes[i:n - w + 1 + i] * _PLACE[i]
    # a short text's only shingle must not meet a full shingle
    return mix(h ^ np.uint64(width - w))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
