"""Session helpers: build a local session for tests/bench, find the shared
checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "paircraft") -> SparkSession:
    """Local session used by tests and bench; on a cluster pass the existing
    session around instead of calling this."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.default.parallelism", str(partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("PAIRCRAFT_DRIVER_MEM", "16g"))
         .config("spark.ui.enabled", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session without one (tests) gets a scratch folder; on a
    cluster a machine's own folder would be lost with the machine, so there
    the setting is required.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="paircraft-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


#: Spark lets go of the shuffle files of an action when it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession):
    """Actions in here let go of their shuffle files as soon as they are over."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; the shuffle files that made it
    are let go at once, not when the driver happens to collect its garbage."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_let_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting of the time when it is made


@contextlib.contextmanager
def staged(df: DataFrame):
    """``df`` written as compressed columns into the checkpoint folder, for what
    is read for a while only: it is deleted at the end of the block."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        with shuffles_let_go(spark):
            df.select("*").write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
