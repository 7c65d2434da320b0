"""Group-aware split and sampling.

The split is stateless: a group's bucket is a hash of (group key, seed), so
every row is assigned without a shuffle, whole groups stay together, and any
engine with md5 computes the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.schema import SAMPLE_N, SAMPLE_SEED, SPLIT_CUTS, SPLIT_SEED


def group_key(a: str = "qid1", b: str = "qid2") -> Column:
    """Group of a pair = the smaller of its two ids."""
    return F.least(F.col(a), F.col(b))


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 32 bits of md5(key || '-' || seed)."""
    h = F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def group_split(df: DataFrame, seed: int = SPLIT_SEED, cuts=SPLIT_CUTS) -> DataFrame:
    """80/10/10 train/valid/test of **groups** (P2); adds ``grp``, ``bucket``,
    ``split``. No shuffle: a projection."""
    b = hash_bucket(group_key(), seed)
    return (df.withColumn("grp", group_key()).withColumn("bucket", b)
              .withColumn("split", F.when(F.col("bucket") < cuts[0], "train")
                                    .when(F.col("bucket") < cuts[1], "valid").otherwise("test")))


def group_split_exact(df: DataFrame, seed: int = SPLIT_SEED, cuts=SPLIT_CUTS) -> DataFrame:
    """``group_split`` with exact shares of the groups (P2): groups stand in the
    order of their hash and are cut at floor(n * cut / 100). Their places come
    from a prefix count over ranges of the hash, no task sees all groups; ties
    of the hash cannot be, the group is part of the key. Null groups are one
    group. Adds ``grp`` and ``split``."""
    from paircraft.plans.ordered import join_null_safe, ordered_cumsum
    named = df.withColumn("grp", group_key())
    order = F.concat_ws("-", F.md5(F.concat_ws("-", F.col("grp").cast("string"), F.lit(str(seed)))), F.col("grp").cast("string"))
    groups = named.select("grp").distinct().select("grp", order.alias("_order"), F.lit(1).alias("one"))
    placed = ordered_cumsum(groups, "_order", ["one"])
    n = groups.agg(F.count(F.lit(1))).scalar()
    placed = placed.select("grp", "cum_one", n.alias("n"))
    upto = lambda cut: F.col("cum_one") <= F.floor(F.col("n") * cut / 100)
    split = F.when(upto(cuts[0]), "train").when(upto(cuts[1]), "valid").otherwise("test")
    return join_null_safe(named, placed.select("grp", split.alias("split")), ["grp"])


def split_counts(split_df: DataFrame) -> DataFrame:
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_pairs"),
                                         F.countDistinct("grp").alias("n_groups"))


def leak_audit(split_df: DataFrame) -> DataFrame:
    """Question ids that occur in more than one split (P3): explode both ids,
    count distinct splits per id."""
    ids = split_df.select(F.explode(F.array("qid1", "qid2")).alias("qid"), "split")
    return (ids.groupBy("qid").agg(F.countDistinct("split").alias("n_splits"),
                                   F.array_sort(F.collect_set("split")).alias("splits"))
               .where(F.col("n_splits") > 1))


def sample_n(df: DataFrame, key: str, n: int = SAMPLE_N, seed: int = SAMPLE_SEED) -> DataFrame:
    """Fixed-size sample of n rows (P4): the n smallest md5(key || seed);
    TakeOrdered keeps only n rows per partition before the final merge."""
    h = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def with_batch(df: DataFrame, key: str, epoch: int, n_batches: int) -> DataFrame:
    """Add ``batch``, a row's mini-batch in an epoch (P5): a hash of the key
    and the epoch, so batches differ by epoch and nothing is shuffled."""
    return df.withColumn("batch", hash_bucket(F.col(key), SPLIT_SEED + epoch, n_batches))


def minibatch(df: DataFrame, key: str, epoch: int, n_batches: int, batch: int) -> DataFrame:
    """Rows of mini-batch ``batch`` in epoch ``epoch`` (P5)."""
    return with_batch(df, key, epoch, n_batches).where(F.col("batch") == batch).drop("batch")
