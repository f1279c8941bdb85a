"""Weights of interactions: event type, age, popularity; applied in this order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_weight(value: Column, event: Column, weights: dict[str, float]) -> Column:
    """value times the weight of its event type; unknown and null types keep the value."""
    if not weights:
        return value
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return value * F.coalesce(known[event], F.lit(1.0))


def decay(value: Column, days: Column, rate: float) -> Column:
    """value * exp(-rate * days); a null age keeps the value, a negative one amplifies."""
    return value if rate == 0 else F.when(days.isNull(), value).otherwise(value * F.exp(F.lit(-rate) * days))


def inverse_propensity(df: DataFrame, alpha: float, item: str = "item_id", value: str = "value") -> DataFrame:
    """value / (count of the item / largest count) ** alpha. Counts are aggregated and joined back, not windowed."""
    if alpha == 0:
        return df
    counts = df.groupBy(F.col(item).alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 1
    counts = counts.select("__i", F.pow(F.col("__n") / F.lit(most), alpha).alias("__p"))
    out = df.join(counts, F.col(item) == F.col("__i"))
    return out.withColumn(value, F.when(F.col("__p") > 1e-12, F.col(value) / F.col("__p")).otherwise(F.col(value))).drop("__i", "__p")


def weigh(df: DataFrame, event_weights: dict[str, float] | None = None, decay_rate: float = 0.0, ips_alpha: float = 0.0) -> DataFrame:
    """user_id, item_id, value with all weights that are active; rows with a null in any of the three are left out first."""
    if decay_rate < 0 or ips_alpha < 0:
        raise ValueError("rates must not be negative")
    df = df.dropna(subset=["user_id", "item_id", "value"])
    value = F.col("value")
    if event_weights and dict(df.dtypes).get("event_type") == "string":
        value = event_weight(value, F.col("event_type"), event_weights)
    if decay_rate and dict(df.dtypes).get("days_ago") in ("double", "float", "int", "bigint"):
        value = decay(value, F.col("days_ago"), decay_rate)
    return inverse_propensity(df.select("user_id", "item_id", value.alias("value")), ips_alpha)
