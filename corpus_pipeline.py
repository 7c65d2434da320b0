"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. Stages 1 to 4 return the columns of ``documents``, stage 5 the pieces of
packed sequences. Null, empty and repeated rows are handled as the operators
define it: texts without letters go at the first stage; the others stay or go
by what the operators find in them. An empty table passes as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paircraft.llm import jaccard_join, langid, line_dedup, packing, secrets
from paircraft.llm.common import table
from paircraft.session import ensure_checkpoint_dir

#: Documents whose best language has a smaller share of the probability are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the training folds know."""
    return langid.in_learned_language(docs, MIN_LANGUAGE_SCORE)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share."""
    return line_dedup.dedup(docs, F.col("source"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    found = jaccard_join.jaccard_components(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; a source is an owner."""
    return secrets.redact(docs, F.col("source"), F.struct("source", "lang"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("line dedup", without_boilerplate), ("near duplicates", one_of_each_group),
          ("secrets", without_secrets), ("packing", packed)]

#: SQL can't express the language model's training and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet
    in the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
