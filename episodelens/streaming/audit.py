"""Frame streams: counts by window with a watermark, and audits of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def audit_stream(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's violations as Parquet, in a folder of the batch, so that a repeated batch replaces its own."""
    write = lambda df, epoch: audit(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
