"""Following the logs of a repository as a stream.

Commits and changes are appended as Parquet files, so a file stream sees each once; repeated states
are dropped by their sum. The watermark bounds the memory for what has been seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "statesum string, elt_id bigint, op string, elt {elt}, received_at timestamp"


def changes_stream(spark: SparkSession, folder: str, elt_type: str = "string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHANGES.format(elt=elt_type)).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def known_once(changes: DataFrame, late: str = "30 days") -> DataFrame:
    """Each change of a commit once, though it may be delivered again within ``late``."""
    return changes.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["statesum", "elt_id"])


def counts(changes: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window start, op, n) of changes by time of receipt."""
    return changes.withWatermark("received_at", late).groupBy(F.window("received_at", window).alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def fold_into(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``apply``; it is repeated with the same number after a failure, so
    ``apply`` should write under that number and replace what is there."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
