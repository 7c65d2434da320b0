"""One query per operator: ``QUERIES`` by name, ``ORACLE`` where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paircraft.llm import (bpe, hard_negatives, jaccard_join, langid, line_dedup, merkle, minhash, ngram_lm, packing, quality,
                           secrets, suffix_dedup, warc)
from paircraft.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every text and of its edited form."""
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; a source is an owner, its part in one language a repository."""
    return secrets.report(table(spark, sf_dir, "documents"), F.col("source"), F.struct("source", "lang"))


ORACLE["op3_secrets"] = secrets.oracle()


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC archives of every page, written and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every text under a backoff automaton of the training texts."""
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines of every document; a source is a site."""
    return line_dedup.report(table(spark, sf_dir, "documents"), F.col("source"))


ORACLE["op7_line_dedup"] = line_dedup.oracle()


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and a learned decision list's verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, digested, and the bytes they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector against all vectors."""
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


ORACLE["op11_hard_negatives"] = hard_negatives.oracle()


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with a version of the tree per tampered one."""
    return merkle.report(table(spark, sf_dir, "documents"))


ORACLE["op12_merkle"] = merkle.oracle()


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 100-byte strings that start earlier."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


ORACLE["op13_suffix_dedup"] = suffix_dedup.oracle()
