"""Request limits over a stream: counts in fixed windows, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(events: DataFrame, most: int = 10, window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """A row for each actor and closed window: requests, and how many of them were refused."""
    actor = F.sha2(F.col("user_id").cast("string"), 256).alias("actor")
    n = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), actor).agg(F.count(F.lit(1)).alias("requests"))
    return n.select("actor", F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - most).alias("refused"))
