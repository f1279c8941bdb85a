"""Histories as padded sequences, next-item pairs, positive pairs and feature tables."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.operators.mappings import index, known
from veldt.session import cut, hint

#: Rows of one user above which they are cut into so many spans of age.
HOT, SPANS = 1_000_000, 256


def padded_sequences(interactions: DataFrame, items: DataFrame, length: int, ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """user_id, input, target: the last length + 1 items of each user with at least two, oldest first, left padded with 0.

    Tokens are item indices plus 1. Rows with a null user, item or age, or an unknown item, are left out. Equal ages
    are ordered by the tie columns. Only the newest length + 1 rows of a user are gathered.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    hist = histories(interactions, items, length + 1, ties).filter(F.size("h") >= 2)
    pad = lambda arr: F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(arr)), arr)
    front, back = F.slice("h", F.lit(1), F.size("h") - 1), F.slice("h", F.lit(2), F.size("h") - 1)
    return hist.select("user_id", pad(front).alias("input"), pad(back).alias("target"))


def histories(interactions: DataFrame, items: DataFrame, length: int, ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """user_id, h: the tokens (item index plus 1) of the newest `length` known items of each user, oldest first."""
    if length < 1:
        raise ValueError("length must be at least 1")
    rows = known(interactions.dropna(subset=["user_id", "item_id", "days_ago"]), "item_id", items, "__i").withColumn("token", F.col("__i") + 1)
    newest = W.partitionBy("user_id").orderBy(F.col("days_ago"), *[F.col(t).desc() for t in ties])
    kept = rows.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= length)
    return kept.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col("token").cast("bigint").alias("t")))), lambda x: x["t"]).alias("h"))


def next_items(interactions: DataFrame, ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """user_id, item_id, next_item_id: each interaction with the one that follows, oldest first.

    Users with more than HOT rows are cut into spans of age, each sorted in a task of its own; the last row of a span is
    followed by the first of the next.
    """
    rows = interactions.dropna(subset=["user_id", "item_id", "days_ago"])
    following = lambda *by: F.lead("item_id").over(W.partitionBy(*by).orderBy(F.col("days_ago").desc(), *ties))
    hot = cut(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("user_id"))
    if hot.isEmpty():
        out = rows.withColumn("next_item_id", following("user_id"))
    else:
        many = rows.join(hint(hot), "user_id", "left_semi")
        edges = cut(many.groupBy("user_id").agg(F.percentile_approx("days_ago", [x / SPANS for x in range(1, SPANS)], 10_000).alias("edges")))
        many = many.join(hint(edges), "user_id").withColumn("span", -F.size(F.filter("edges", lambda e: e < F.col("days_ago")))).drop("edges")
        first = F.min_by("item_id", F.struct((-F.col("days_ago")).alias("o"), *ties))
        starts = many.groupBy("user_id", "span").agg(first.alias("first"))
        starts = cut(starts.select("user_id", "span", F.lead("first").over(W.partitionBy("user_id").orderBy("span")).alias("then")))
        many = many.join(hint(starts), ["user_id", "span"]).withColumn("next_item_id", F.coalesce(following("user_id", "span"), "then")).drop("span", "then")
        few = rows.join(hint(hot), "user_id", "left_anti").withColumn("next_item_id", following("user_id"))
        out = few.unionByName(many)
    return out.filter("next_item_id is not null").select("user_id", "item_id", "next_item_id")


def positive_pairs(interactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user_idx, item_idx) of rows with a positive value (1 where there is no value column), users and items.

    User indices start at 1: 0 is the cold-start row. Null ids are left out.
    """
    rows = interactions.dropna(subset=["user_id", "item_id"])
    if "value" in interactions.columns:
        rows = rows.filter(F.coalesce(F.col("value"), F.lit(0.0)) > 0)
    users, items = index((rows, "user_id")), index((rows, "item_id"))
    users = users.withColumn("idx", F.col("idx") + 1)
    pairs = known(known(rows.select("user_id", "item_id"), "user_id", users, "user_idx"), "item_id", items, "item_idx")
    return pairs.select("user_idx", "item_idx"), users, items


def feature_kinds(features: DataFrame) -> DataFrame:
    """feature_name, categorical: whether every value of the feature is 1; nulls count as 0 and make it a number."""
    one = F.abs(F.coalesce("value", F.lit(0.0)) - 1) <= 2.220446049250313e-16
    return features.groupBy(F.coalesce("feature_name", F.lit("")).alias("feature_name")).agg(F.bool_and(one).alias("categorical"))


def feature_table(features: DataFrame, id_: str, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_idx, cat, dense) for entities with features, and (feature_name, categorical, slot): slots by name within a kind.

    Kinds are judged over the whole file, unknown entities included; of repeated numbers the largest holds.
    """
    kinds = feature_kinds(features)
    slots = kinds.withColumn("slot", F.row_number().over(W.partitionBy("categorical").orderBy("feature_name")) - 1)
    n_dense = slots.filter(~F.col("categorical")).count()
    rows = known(features.withColumn("feature_name", F.coalesce("feature_name", F.lit(""))), id_, entities, "entity_idx").join(slots, "feature_name")
    cells = rows.groupBy("entity_idx", "categorical", "slot").agg(F.max(F.coalesce("value", F.lit(0.0))).alias("v"))
    cat = F.sort_array(F.collect_set(F.when(F.col("categorical"), F.col("slot"))))
    dense = F.map_from_entries(F.collect_list(F.when(~F.col("categorical"), F.struct("slot", "v"))))
    table = cells.groupBy("entity_idx").agg(cat.alias("cat"), dense.alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_dense - 1)), lambda s: F.coalesce(F.col("m")[s], F.lit(0.0))) if n_dense else F.array().cast("array<double>")
    return table.select("entity_idx", "cat", filled.alias("dense")), slots
