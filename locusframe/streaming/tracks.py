"""Tracks built from streams of reads.

Counts add up, so a track is kept as partial tables, one a micro-batch, and summed when it is read; a batch that is
replayed after a failure overwrites its own partial table, and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.track import read_track


def live_counts(reads: DataFrame, **how) -> DataFrame:
    """Running counts of a stream of reads, for output modes 'complete' and 'update'."""
    return read_track(reads, **how)


def write_partials(reads: DataFrame, folder: str, checkpoint: str, once: bool = True, **how) -> StreamingQuery:
    """Starts a query that writes each micro-batch's counts to ``folder``/batch=<number>."""

    def put(batch: DataFrame, number: int) -> None:
        read_track(batch, **how).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    started = reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The track of all batches so far."""
    parts = spark.read.parquet(folder)
    return parts.groupBy("chrom", "start", "end", "strand", "condition").agg(F.sum("value").alias("value"))
