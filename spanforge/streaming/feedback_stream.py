"""Feedback as a stream: an extension of the batch report, with event time and late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def query_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per normalised query and tumbling window; events older than the watermark are dropped."""
    e = events.withWatermark("ts", late).withColumn("query", T.query_key(F.col("query")))
    g = e.groupBy(F.window("ts", window).alias("w"), "query")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("no_answer")).alias("no_answer"), F.count_if(~F.coalesce(F.col("useful"), F.lit(True))).alias("negative")).select(F.col("w.start").alias("start"), "query", "n", "no_answer", "negative")
