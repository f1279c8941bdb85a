"""Ranking metrics as plain functions and as one DataFrame pass for many cut-offs."""

from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NothingKnown(ValueError):
    """No test user and item is known to the model."""


def precision_at_k(recommended: list, relevant: set, k: int) -> float:
    return len(set(recommended[:k]) & set(relevant)) / k if k else 0.0


def recall_at_k(recommended: list, relevant: set, k: int) -> float:
    return len(set(recommended[:k]) & set(relevant)) / len(relevant) if relevant else 0.0


def ndcg_at_k(recommended: list, relevant: set, k: int, clamp_k_to_list: bool = False) -> float:
    """Binary gains; clamp_k_to_list shortens the ideal list to the recommended one."""
    k = min(k, len(recommended)) if clamp_k_to_list else k
    best = sum(1 / log2(r + 2) for r in range(min(len(relevant), k)))
    return sum(1 / log2(r + 2) for r, x in enumerate(recommended[:k]) if x in relevant) / best if best else 0.0


def mean_average_precision(recommended: list, relevant: set, divide_by: int | None = None) -> float:
    """Precision at each hit over the number of relevant items (or another number)."""
    hits, total = 0, 0.0
    for r, x in enumerate(recommended, 1):
        if x in relevant:
            hits += 1
            total += hits / r
    n = len(relevant) if divide_by is None else divide_by
    return total / n if n else 0.0


def coverage(lists: list[list], items: int) -> float:
    return len({x for one in lists for x in one}) / items if items else 0.0


def hit_rate_at_k(recommended: list, relevant: set, k: int) -> float:
    return float(bool(set(recommended[:k]) & set(relevant)))


def neighbour_recall(approximate: list, exact: list) -> float:
    return len(set(approximate) & set(exact)) / len(exact) if exact else 1.0


def per_user_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], clamp_k_to_list: bool = False, n_rel: DataFrame | None = None) -> DataFrame:
    """user_id, k and the five metrics for every user with relevant items; users without recommendations score 0.

    One aggregation over the recommended rows: hits carry their rank and their running number, as an array of at most
    as many entries as the longest list. n_rel: users and how many items are relevant to them, where that is known; then
    relevant may leave out what nobody was recommended.
    """
    rel = relevant.select("user_id", "item_id").distinct()
    n_rel = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel")) if n_rel is None else n_rel
    hits = ranked.join(rel, ["user_id", "item_id"]).groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("rank").cast("int"))).alias("hits"))
    length = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    users = n_rel.join(hits, "user_id", "left").join(length, "user_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>"))).withColumn("length", F.coalesce("length", F.lit(0)))
    rows = users.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    top = F.filter("hits", lambda r: r <= F.col("k"))
    n = F.size(top)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    gain = lambda arr: total(F.transform(arr, lambda r: F.lit(1.0) / F.log2(r.cast("double") + 1)))
    ideal = F.least("n_rel", F.least("k", "length") if clamp_k_to_list else F.col("k")).cast("int")
    ideal_gain = F.when(ideal < 1, F.lit(0.0)).otherwise(gain(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1)))))
    ap = total(F.transform(top, lambda r, i: (i + 1).cast("double") / r))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return rows.select("user_id", "k", safe(n.cast("double"), F.col("k")).alias("precision"), safe(n.cast("double"), F.col("n_rel")).alias("recall"), safe(gain(top), ideal_gain).alias("ndcg"), safe(ap, F.col("n_rel")).alias("map"), (n > 0).cast("double").alias("hit_rate"))


def mean_metrics(per_user: DataFrame) -> DataFrame:
    """k and the means over users."""
    return per_user.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg", "map", "hit_rate")])


def catalogue_coverage(ranked: DataFrame, k: int, items: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).agg((F.countDistinct("item_id") / F.lit(max(items, 1))).alias("coverage"))


def evaluate(model, train: DataFrame, test: DataFrame, user_features: DataFrame | None = None, ks: tuple[int, ...] = (5, 10, 20, 50), clamp_k_to_list: bool = False) -> tuple[DataFrame, DataFrame]:
    """(k, metrics) and (coverage, n_users): test users of the model's training, its items only, seen items excluded.

    Raises if nobody is left. model has items and recommend(interactions, features, k).
    """
    from veldt.session import cut, hint

    items = train.sparkSession.createDataFrame([(x,) for x in model.items], "item_id string")
    relevant = cut(test.select(F.col("user_id").cast("string"), F.col("item_id").cast("string")).dropna().distinct().join(hint(items), "item_id", "left_semi").join(train.select(F.col("user_id").cast("string")).distinct(), "user_id", "left_semi"))
    users = relevant.select("user_id").distinct()
    n = users.count()
    if not n:
        raise NothingKnown("no test user and item is known to the model")
    history = train.join(users, "user_id", "left_semi")
    features = user_features.join(users, "user_id", "left_semi") if user_features is not None else None
    options = {"exact": True} if getattr(model, "index", None) else {}  # evaluation never asks an approximate index
    ranked = cut(model.recommend(history, features, max(ks), **options))
    summary = catalogue_coverage(ranked, max(ks), len(model.items)).withColumn("n_users", F.lit(n))
    return mean_metrics(per_user_metrics(ranked, relevant, list(ks), clamp_k_to_list)), summary
