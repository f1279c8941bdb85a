"""Interactions as a stream: windowed item counts with late data. Every delivery counts; unusable rows do not."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import blank, usable


def windowed_scores(stream: DataFrame, at: str = "loaded_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, item_id, n, total for usable rows; works on streams and on batch tables alike."""
    rows = stream.filter(~blank(F.col("user_id")) & ~blank(F.col("item_id")) & usable(F.col("value")))
    rows = rows.withWatermark(at, late) if stream.isStreaming else rows
    out = rows.groupBy(F.window(at, window).alias("w"), "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "item_id", "n", "total")
