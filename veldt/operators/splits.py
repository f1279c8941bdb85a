"""Deterministic splits: hashes order rows, so a result does not depend on partitions or a clock."""

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import cut, hint


#: Rows of one user above which they are ranked in hash ranges, each in a task of its own.
HOT = 1_000_000


@dataclass
class Split:
    train: DataFrame
    test: DataFrame

    @cached_property
    def stats(self) -> dict[str, int]:
        count = lambda df, s: dict(zip((f"{s}_interactions", f"{s}_users"), df.agg(F.count(F.lit(1)), F.countDistinct("user_id")).first()))
        return count(self.train, "train") | count(self.test, "test")

    def write(self, train: str | None = None, test: str | None = None, folder: str | None = None) -> "SplitResult":
        """Writes both parts and counts what was written. Both paths are given or neither; then they lie in the folder
        (default: a new one in the shared folder), which belongs to the caller."""
        from veldt.session import shared_dir
        from veldt.sources.io import write

        if (train is None) != (test is None):
            raise ValueError("both paths must be given or neither")
        spark = self.train.sparkSession
        if train is None:
            folder = (folder or f"{shared_dir(spark)}/split-{uuid.uuid4().hex}").rstrip("/")
            train, test = f"{folder}/train.parquet", f"{folder}/test.parquet"
        write(self.train, train)
        write(self.test, test)
        stats = Split(spark.read.parquet(train), spark.read.parquet(test)).stats
        return SplitResult(train, test, **stats)


@dataclass(frozen=True)
class SplitResult:
    train_path: str
    test_path: str
    train_interactions: int
    train_users: int
    test_interactions: int
    test_users: int


def shuffled(*parts: Column | str, seed: int = 42) -> Column:
    """A hash that orders rows like a shuffle; the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def _placed(df: DataFrame, row: list[str], seed: int) -> DataFrame:
    """df with __rn, a row's place among the rows of its user in hash order, and __n, their number; null for null users.

    Users with more than HOT rows are ranked inside ranges of the hash, from the number of rows in the ranges before.
    """
    rows = df.withColumn("__h", shuffled("user_id", *row, seed=seed))
    mine, order = W.partitionBy("user_id"), W.partitionBy("user_id").orderBy("__h", *row)
    plain = lambda x: x.withColumn("__rn", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(mine))
    nobody = rows.filter("user_id is null").withColumn("__rn", F.lit(None).cast("int")).withColumn("__n", F.lit(None).cast("bigint"))
    some = rows.filter("user_id is not null")
    hot = cut(df.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT))
    if hot.isEmpty():
        return plain(some).unionByName(nobody).drop("__h")
    many = some.join(hint(hot), "user_id").withColumn("__g", F.substring("__h", 1, 3))
    sizes = many.groupBy("user_id", "__g").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("user_id").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select("user_id", "__g", before.alias("__before")))
    at = F.row_number().over(W.partitionBy("user_id", "__g").orderBy("__h", *row)) + F.col("__before")
    many = many.join(hint(starts), ["user_id", "__g"]).withColumn("__rn", at).drop("__g", "__before")
    few = plain(some.join(hint(hot.select("user_id")), "user_id", "left_anti"))
    return few.unionByName(many).unionByName(nobody).drop("__h")


def _cut(df: DataFrame, test: Column) -> Split:
    """Two complementary predicates on one frame; rows without a user stay in train."""
    held = F.coalesce(F.col("user_id").isNotNull() & test, F.lit(False))
    return Split(df.filter(~held).drop("__rn", "__n"), df.filter(held).drop("__rn", "__n"))


def random_split(df: DataFrame, ratio: float = 0.2, seed: int = 42, row: list[str] | None = None) -> Split:
    """About `ratio` of each user's rows into test, at least one and never all; users with one row stay in train.

    `row` names the columns that tell a user's rows apart (default: all but user_id). Half counts round up.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    row = row or [c for c in df.columns if c != "user_id"]
    n = F.col("__n")
    test = F.when(n < 2, F.lit(0)).otherwise(F.least(F.greatest(F.round(n * ratio), F.lit(1)), n - 1))
    return _cut(_placed(df, row, seed), F.col("__rn") <= test)


def leave_k_out(df: DataFrame, k: int = 1, seed: int = 42, row: list[str] | None = None) -> Split:
    """k rows of each user with more than k rows into test."""
    if k < 1:
        raise ValueError("k must be at least 1")
    row = row or [c for c in df.columns if c != "user_id"]
    return _cut(_placed(df, row, seed), (F.col("__rn") <= k) & (F.col("__n") > k))


def temporal_split(df: DataFrame, cutoff_days: float) -> Split:
    """Rows at most so many days old into test. A null age raises."""
    if df.filter("days_ago is null").limit(1).count():
        raise ValueError("days_ago must not be null")
    return Split(df.filter(F.col("days_ago") > cutoff_days), df.filter(F.col("days_ago") <= cutoff_days))


def user_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """user_id, fold: users in hash order, dealt in blocks whose sizes differ by one at most (the first ones larger).

    Ranks are counted inside hash ranges and joined by offsets, so no task sees all users.
    """
    users = df.select("user_id").dropna().distinct().withColumn("h", shuffled("user_id", seed=seed)).withColumn("g", F.substring("h", 1, 3))
    users = cut(users)
    total = users.count()
    sizes = users.groupBy("g").agg(F.count(F.lit(1)).alias("c"))  # at most 4096 rows
    before = F.coalesce(F.sum("c").over(W.partitionBy(F.lit(1)).orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(W.partitionBy("g").orderBy("h", "user_id")) - 1 + F.col("before")
    small_, extra = total // k, total % k
    edge = extra * (small_ + 1)
    fold = F.when(F.col("at") < edge, F.floor(F.col("at") / (small_ + 1))).otherwise(extra + F.floor((F.col("at") - edge) / max(small_, 1)))
    return users.join(F.broadcast(sizes.withColumn("before", before).drop("c")), "g").withColumn("at", at).select("user_id", fold.cast("int").alias("fold"))


def row_folds(df: DataFrame, k: int, seed: int = 42, row: list[str] | None = None) -> DataFrame:
    """All rows with a fold: each user's rows in hash order, dealt round."""
    row = row or [c for c in df.columns if c != "user_id"]
    return _placed(df.filter("user_id is not null"), row, seed).withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__n")
