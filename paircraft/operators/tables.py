"""Table operators: null drop, lengths, distinct questions, id resolution,
frequencies, unions (F1-F3, F9, U1-U3, J1-J3, J5, A9, W4)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paircraft.functions.text import char_count, word_count


def drop_null_pairs(df: DataFrame, cols: Sequence[str] = ("question1", "question2")) -> DataFrame:
    """Drop rows whose key text is null (F1)."""
    return df.dropna(subset=list(cols))


def conform_label(df: DataFrame, col: str = "is_duplicate") -> DataFrame:
    """Labels as 0/1 int."""
    return df.withColumn(col, F.col(col).cast("int"))


def pair_lengths(df: DataFrame) -> DataFrame:
    """Raw char and word counts per side and their absolute differences."""
    return df.select(
        "*",
        char_count("question1").alias("q1_len"), char_count("question2").alias("q2_len"),
        word_count("question1").alias("q1_words"), word_count("question2").alias("q2_words"),
    ).withColumn("len_diff", F.abs(F.col("q1_len") - F.col("q2_len"))) \
     .withColumn("word_diff", F.abs(F.col("q1_words") - F.col("q2_words")))


def text_key(col) -> F.Column:
    """Stable content key of a text (128-bit md5 hex): no collisions at scale
    and identical across engines (W4, X24)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.encode(c, "UTF-8"))


def distinct_questions(pairs: DataFrame) -> DataFrame:
    """(qkey, question): distinct non-null texts over both columns.
    One pass: ``explode(array(q1, q2))`` then ``distinct`` (partial
    aggregation on the key before the shuffle)."""
    t = pairs.select(F.explode(F.array("question1", "question2")).alias("question")) \
             .where(F.col("question").isNotNull())
    return t.groupBy(text_key("question").alias("qkey")).agg(F.first("question").alias("question"))


def with_keys(pairs: DataFrame) -> DataFrame:
    """The content keys of both sides; pairs that bring them need no texts."""
    if {"qkey1", "qkey2"} <= set(pairs.columns):
        return pairs
    return pairs.withColumn("qkey1", text_key("question1")).withColumn("qkey2", text_key("question2"))


def resolve_pairs(pairs: DataFrame, qtab: DataFrame) -> DataFrame:
    """Attach the question keys of both sides (J1); ``unresolved_pairs`` lists
    the pairs that have a side missing from ``qtab``."""
    k = qtab.select("qkey")
    p = with_keys(pairs)
    return (p.join(k.withColumnRenamed("qkey", "qkey1"), "qkey1")
             .join(k.withColumnRenamed("qkey", "qkey2"), "qkey2"))


def unresolved_pairs(pairs: DataFrame, qtab: DataFrame) -> DataFrame:
    k = qtab.select("qkey")
    p = with_keys(pairs).select("pair_id", "qkey1", "qkey2")
    miss1 = p.join(k.withColumnRenamed("qkey", "qkey1"), "qkey1", "left_anti")
    miss2 = p.join(k.withColumnRenamed("qkey", "qkey2"), "qkey2", "left_anti")
    return miss1.unionByName(miss2).select("pair_id").distinct()


def require_resolved(pairs: DataFrame, qtab: DataFrame) -> DataFrame:
    """Raise when any pair side is unknown (the reference's KeyError)."""
    n = unresolved_pairs(pairs, qtab).limit(1).count()
    if n:
        raise KeyError("question not found in question table")
    return resolve_pairs(pairs, qtab)


def item_frequency(df: DataFrame, a: str = "qid1", b: str = "qid2", name: str = "qid") -> DataFrame:
    """(name, freq): occurrences over two columns, one scan."""
    return (df.select(F.explode(F.array(a, b)).alias(name)).where(F.col(name).isNotNull())
              .groupBy(name).agg(F.count(F.lit(1)).alias("freq")))


def attach_min_freq(pairs: DataFrame, freq: DataFrame, key: str = "qid") -> DataFrame:
    """Frequency of both sides and their minimum (J2). Two left joins on the
    key; missing = 0."""
    f1 = freq.select(F.col(key).alias("qid1"), F.col("freq").alias("freq1"))
    f2 = freq.select(F.col(key).alias("qid2"), F.col("freq").alias("freq2"))
    out = pairs.join(f1, "qid1", "left").join(f2, "qid2", "left")
    return (out.withColumn("freq1", F.coalesce("freq1", F.lit(0)))
               .withColumn("freq2", F.coalesce("freq2", F.lit(0)))
               .withColumn("min_freq", F.least("freq1", "freq2")))


def gather_pair_vectors(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id",
                        col: str = "embedding") -> DataFrame:
    """Per-question vectors for both sides: two equi-joins on the key."""
    v1 = vectors.select(F.col(key).alias("qid1"), F.col(col).alias("u"))
    v2 = vectors.select(F.col(key).alias("qid2"), F.col(col).alias("v"))
    return pairs.join(v1, "qid1").join(v2, "qid2")


def union_with_tag(frames: dict, col: str = "split") -> DataFrame:
    """``unionByName`` of tagged frames."""
    out = None
    for tag, df in frames.items():
        t = df.withColumn(col, F.lit(tag))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
