"""Mentions per id and window of event time, over a stream or a table.

Late rows count until the watermark has passed their window; rows without a time are left out. State is one counter per open
window and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_mentions(documents: DataFrame, time: str = "ingested", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``win_start, qid, n`` for documents with ``entities`` and a time column; streams drop what is later than ``late``."""
    rows = documents.filter(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    flat = rows.select("at", F.explode("entities").alias("e")).filter(F.col("e.qid").isNotNull()).select("at", F.col("e.qid").alias("qid"))
    counts = flat.groupBy(F.window("at", width).alias("w"), "qid").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("win_start"), "qid", "n")


def started(counts: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A query over all that is there, into a table in memory; the checkpoint folder lets it go on after a failure."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
