"""Follow the append-only metric log with Structured Streaming.

``follow_log`` reads new text files under the log root, parses them with
``metric_log.parse_log`` and adds the records to a parquet table, a folder
per batch. With
``availableNow`` it processes what is there and stops; the checkpoint
records which files were done, so a rerun (or a restart after a failure)
only parses new files.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paircraft.session import ensure_checkpoint_dir
from paircraft.sources.metric_log import parse_log


def follow_log(spark: SparkSession, log_root: str, out_path: str, checkpoint: str | None = None):
    """Parse every not-yet-seen log file into ``out_path`` (parquet, append).
    Returns the finished streaming query."""
    ck = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "log_follow")
    raw = (spark.readStream.format("text").option("recursiveFileLookup", "true").load(log_root)
                .select(F.col("value")))

    def write_batch(batch_df, epoch_id):
        # a batch that is run again after a failure replaces its own folder
        parse_log(batch_df).drop("attrs").write.mode("overwrite").parquet(f"{out_path}/batch={epoch_id}")

    q = (raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", ck)
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
