"""Wide sources into long features: melt, split, buckets, and a declarative transform that can be stored."""

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.session import col


def interactions_from_views(df: DataFrame, user: str, item: str, seconds: str, at: str | None = None, event: str | None = None, as_of: str | None = None, min_seconds: float = 30.0) -> DataFrame:
    """user_id, item_id, value = ln(seconds + 1) [, event_type] [, days_ago]: views of at least min_seconds, distinct.

    Null ids are left out. days_ago counts whole days up to the given date, so that the result does not move with the clock.
    """
    cols = [col(user).cast("string").alias("user_id"), col(item).cast("string").alias("item_id"), F.log1p(col(seconds)).alias("value")]
    if event:
        cols.append(col(event).alias("event_type"))
    if at:
        if not as_of:
            raise ValueError("as_of is needed for days_ago")
        cols.append(F.datediff(F.lit(as_of).cast("date"), F.to_date(col(at))).cast("double").alias("days_ago"))
    return df.filter(col(seconds) >= min_seconds).select(*cols).dropna(subset=["user_id", "item_id"]).distinct()


def melt(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, feature_name = column_value, value = 1.0: one pass over all columns; nulls are left out, rows are distinct."""
    if not columns:
        return df.select(col(key), F.lit("").alias("feature_name"), F.lit(1.0).alias("value")).limit(0)
    names = F.array(*[F.when(col(c).isNotNull(), F.concat(F.lit(f"{c}_"), col(c).cast("string"))) for c in columns])
    rows = df.select(col(key), F.explode(names).alias("feature_name")).filter("feature_name is not null")
    return rows.distinct().withColumn("value", F.lit(1.0))


def split_explode(df: DataFrame, key: str, column: str, prefix: str, separator: str = ",", drop_empty: bool = False) -> DataFrame:
    """key, feature_name = prefix + trimmed token, value = 1.0; empty tokens stay unless they are dropped."""
    rows = df.select(col(key), F.explode(F.transform(F.split(col(column), f"\\Q{separator}\\E", -1), lambda t: F.trim(t))).alias("token"))
    rows = rows.filter("token <> ''") if drop_empty else rows
    return rows.select(key, F.concat(F.lit(prefix), "token").alias("feature_name"), F.lit(1.0).alias("value"))


def bucket(value: Column, boundaries: list[float], labels: list[str], prefix: str = "", unknown: str = "unknown") -> Column:
    """The label of the first boundary that is not below the value; the last label holds the rest, unknown null and unreadable ones."""
    check_buckets(boundaries, labels)
    v = value.try_cast("double")
    out = F.when(v.isNull(), F.lit(prefix + unknown))
    for b, label in zip(boundaries, labels):
        out = out.when(v <= b, F.lit(prefix + label))
    return out.otherwise(F.lit(prefix + labels[-1]))


def check_buckets(boundaries: list[float], labels: list[str]) -> None:
    if len(labels) != len(boundaries) + 1:
        raise ValueError("labels must be one more than boundaries")
    if any(a >= b for a, b in zip(boundaries, boundaries[1:])):
        raise ValueError("boundaries must ascend")


def latest(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The latest row of each key, decided by the tie columns; aggregated before the shuffle instead of sorted."""
    order = F.struct(col(at).alias("at"), *[col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    whole = F.struct(*[col(c) for c in df.columns])
    return df.filter(col(key).isNotNull()).groupBy(col(key).alias("__key")).agg(F.max_by(whole, order).alias("__row")).select("__row.*")


@dataclass
class Transform:
    """How raw columns become feature keys: categories as prefix_value, numbers as prefix_bucket."""

    categorical: dict[str, str] = field(default_factory=dict)
    numeric: dict[str, dict] = field(default_factory=dict)

    def add_categorical(self, column: str, prefix: str) -> "Transform":
        self.categorical[column] = prefix.removesuffix("_")
        return self

    def add_numeric(self, column: str, prefix: str, boundaries: list[float], labels: list[str]) -> "Transform":
        check_buckets(boundaries, labels)
        self.numeric[column] = {"prefix": prefix.removesuffix("_"), "boundaries": boundaries, "labels": labels}
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Transform":
        return Transform(**json.loads(text))

    def keys(self, columns: list[str]) -> list[Column]:
        """One feature key per configured column; a missing column counts as unknown."""
        here = lambda c: col(c) if c in columns else F.lit(None).cast("string")
        cats = [F.concat(F.lit(p + "_"), F.coalesce(here(c).cast("string"), F.lit("unknown"))) for c, p in self.categorical.items()]
        return cats + [bucket(here(c).cast("string"), n["boundaries"], n["labels"], n["prefix"] + "_") for c, n in self.numeric.items()]

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """key, feature_name, value = 1.0 for every configured column."""
        keys = self.keys(df.columns)
        if not keys:
            return melt(df, key, [])
        return df.select(col(key), F.explode(F.array(*keys)).alias("feature_name"), F.lit(1.0).alias("value"))
