"""How readily a user repeats items, smoothed towards the global rate."""

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary_share(interactions: DataFrame, vocabulary: DataFrame) -> float:
    """The share of the distinct items (null among them) that a vocabulary (item_id) holds; 0 without any."""
    items = interactions.select(F.col("item_id").cast("string").alias("item_id")).distinct()
    held = vocabulary.select(F.col("item_id").cast("string").alias("item_id"), F.lit(1).alias("__in")).dropna().distinct()
    return items.join(held, "item_id", "left").agg(F.avg(F.coalesce("__in", F.lit(0)))).first()[0] or 0.0


def repeat_affinity(interactions: DataFrame, scale: float = 1.0, prior_strength: float = 10.0, vocabulary: DataFrame | None = None) -> DataFrame:
    """user_id, events, repeats, rho = scale * (1 - (repeats + s * p) / (events + s)), p the global share of repeats.

    Two combining aggregations; the global share is one number on the driver. A vocabulary (item_id) that holds less than half of
    the items warns. Negative parameters raise; an empty table gives no row.
    """
    if scale < 0 or prior_strength < 0:
        raise ValueError("scale and prior_strength must not be negative")
    if vocabulary is not None:
        share = vocabulary_share(interactions, vocabulary)
        if share < 0.5:
            warnings.warn(f"only {share:.0%} of the items are in the vocabulary", stacklevel=2)
    pairs = interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    users = pairs.groupBy("user_id").agg(F.sum("n").alias("events"), F.sum(F.col("n") - 1).alias("repeats"))
    p = users.agg(F.sum("repeats") / F.sum("events")).first()[0] or 0.0
    rho = scale * (1 - (F.col("repeats") + prior_strength * p) / (F.col("events") + prior_strength))
    return users.select("user_id", "events", "repeats", rho.alias("rho"))
