"""Registered split / sampling / union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircraft.operators import split
from paircraft.plans import oracle_sql as O
from paircraft.plans.catalog import register
from paircraft.schema import SAMPLE_N, SAMPLE_SEED, SPLIT_SEED
from paircraft.sources import fixtures as fx

_SPLIT = O.with_(O.DOC_PAIRS, f"""
_s0 AS (SELECT pair_id, qid1, qid2, least(qid1, qid2) AS grp,
               CAST(('0x' || substr(md5(concat(least(qid1, qid2), '-', '{SPLIT_SEED}')), 1, 8))::BIGINT % 100 AS INTEGER) AS bucket
        FROM doc_pairs),
_split AS (SELECT *, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'valid' ELSE 'test' END AS split FROM _s0)""")


def _split_df(spark, sf):
    return split.group_split(fx.pair_ids(spark, sf))


@register("group_split", _SPLIT + "\nSELECT pair_id, grp, bucket, split FROM _split")
def group_split(spark, sf):
    """Group-aware 80/10/10 split by a hash of the smaller id."""
    return _split_df(spark, sf).select("pair_id", "grp", "bucket", "split")


@register("group_split_counts", _SPLIT + """
SELECT split, count(*) AS n_pairs, count(DISTINCT grp) AS n_groups FROM _split GROUP BY split""")
def group_split_counts(spark, sf):
    """Pairs and groups per split."""
    return split.split_counts(_split_df(spark, sf))


@register("split_leak_audit", _SPLIT + """,
_ids AS (SELECT qid1 AS qid, split FROM _split UNION ALL SELECT qid2, split FROM _split)
SELECT qid, count(DISTINCT split) AS n_splits, list_sort(list_distinct(list(split))) AS splits
FROM _ids GROUP BY qid HAVING count(DISTINCT split) > 1""")
def split_leak_audit(spark, sf):
    """Question ids that appear in more than one split."""
    return split.leak_audit(_split_df(spark, sf))


@register("sample_n", O.with_(O.DOC_PAIRS) + f"""
SELECT pair_id, qid1, qid2, is_duplicate FROM doc_pairs
ORDER BY md5(concat(pair_id, '-', '{SAMPLE_SEED}')), pair_id LIMIT {SAMPLE_N}""")
def sample_n(spark, sf):
    """Fixed-size sample (32,000 rows, seed 13) of the pairs."""
    p = fx.doc_pairs(spark, sf).select("pair_id", "qid1", "qid2", "is_duplicate")
    return split.sample_n(p, "pair_id")


@register("train_valid_union", _SPLIT + """
SELECT pair_id, split FROM _split WHERE split = 'train'
UNION ALL SELECT pair_id, split FROM _split WHERE split = 'valid'""")
def train_valid_union(spark, sf):
    """Train and valid rows appended for the final refit."""
    s = _split_df(spark, sf)
    return (s.where(F.col("split") == "train").select("pair_id", "split")
             .unionByName(s.where(F.col("split") == "valid").select("pair_id", "split")))
