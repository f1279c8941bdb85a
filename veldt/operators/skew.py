"""Statistics per key with balanced work, and the report of heavy keys.

Per-key counts and sums come from histograms of (key, bin): they combine before the shuffle, and a hot key is spread
over its bins. Quantiles are selected exactly: the bin that holds a wanted rank is split again and again, over merged
counts, until a bin has one value (or the rank is its first or last). Values of a hot key are never gathered.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.functions.text import usable
from veldt.session import col, cut, hint, release, small

#: Parts into which a bin is split in each round.
PARTS = 256
#: Rows of a key above which they are spread over SALTS tasks where they must be joined by a shuffle.
HOT, SALTS = 1_000_000, 64


def _octave(v: Column) -> Column:
    """A number that never falls while v grows: sign and binary exponent. Null for values outside the statistics."""
    e = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(~usable(v), None).when(v == 0, F.lit(0)).otherwise(F.signum(v) * e).cast("int")


def _histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _locate(hist: DataFrame, by: list[str], bin_: str, want: DataFrame) -> DataFrame:
    """For each wanted rank the bin that holds it, with the rank inside the bin. A key has at most a few thousand bins."""
    upto = F.sum("n").over(W.partitionBy(*by).orderBy(bin_).rowsBetween(W.unboundedPreceding, 0))
    cum = hist.withColumn("upto", upto)
    return (
        want.join(cum, by)
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .withColumn("rank", F.col("rank") - (F.col("upto") - F.col("n")))
    )


def _meet(base: DataFrame, bins: DataFrame, per_key: DataFrame) -> DataFrame:
    """Rows with the open bins of their key and octave. Many bins are joined by a shuffle, in which the rows of a hot key
    go to SALTS tasks and its bins to all of them."""
    if small(bins):
        return base.join(F.broadcast(bins), ["k", "bin"])
    hot = hint(per_key.filter(F.col("n") > HOT).select("k", F.lit(SALTS).alias("salts")))
    many = F.coalesce("salts", F.lit(1))
    x = base.join(hot, "k", "left").withColumn("salt", F.pmod(F.xxhash64("v"), many).cast("int")).drop("salts")
    y = bins.join(hot, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    return x.join(y, ["k", "bin", "salt"]).drop("salt")


def key_stats(df: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5,), heavy_share: float | None = None) -> DataFrame:
    """One row per key: key_value, n (rows), n_values (rows with a usable value), total, share of all rows and q0, q1...

    Quantile q is the value of rank max(1, ceil(q * n_values)) in ascending order, exactly. Null, NaN and infinite
    values count in n only; a key without usable values has null total and quantiles. Rows with a null key count in the
    share and give no row; an empty table gives none. Other columns are ignored, whatever their names. Equal values and
    repeated rows count as often as they stand there. With heavy_share only keys with at least that share of all rows
    are reported (at most 1/heavy_share of them), and only they are refined.
    """
    base = cut(df.select(col(key).cast("string").alias("k"), col(value).cast("double").alias("raw")).select("k", F.when(usable(F.col("raw")), F.col("raw")).alias("v"), _octave(F.col("raw")).alias("bin")))
    hist = cut(_histogram(base, "k", "bin"))
    rows = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per_key = hist.filter("k is not null").groupBy("k").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.sum("total").alias("total"))
    per_key = per_key.withColumn("share", F.col("n") / F.lit(max(rows, 1)))
    if heavy_share is not None:
        per_key = per_key.filter(F.col("n") >= heavy_share * F.lit(rows))
    per_key = cut(per_key)
    found = []
    if quantiles:
        ranks = F.posexplode(F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n_values"))) for q in quantiles]))
        want = per_key.filter("n_values > 0").select("k", ranks.alias("q", "rank"))
        hist = hist.filter("bin is not null").join(hint(per_key.select("k")), "k", "left_semi") if heavy_share is not None else hist.filter("bin is not null and k is not null")
        here = cut(_locate(hist, ["k"], "bin", want).select("k", "q", "rank", "n", "lo", "hi"))
        done = (F.col("lo") == F.col("hi")) | (F.col("rank") == 1) | (F.col("rank") == F.col("n"))
        answer = F.when(F.col("rank") == F.col("n"), F.col("hi")).otherwise(F.col("lo"))
        while True:
            found.append(here.filter(done).select("k", "q", answer.alias("x")))
            open_ = here.filter(~done).select("k", "q", "rank", F.col("lo").alias("a"), F.col("hi").alias("b"))
            if open_.isEmpty():
                break
            bins = cut(open_.select("k", "a", "b", _octave(F.col("a")).alias("bin")).distinct())
            part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * PARTS))
            # The two ends always fall into different parts, so that every round makes progress.
            part = F.when(F.col("v") >= F.col("b"), F.lit(PARTS)).otherwise(F.greatest(part, F.lit(0))).cast("int")
            inside = _meet(base.filter("v is not null"), bins, per_key).filter("v between a and b").withColumn("part", part)
            here = cut(_locate(_histogram(inside, "k", "a", "b", "part"), ["k", "a", "b"], "part", open_).select("k", "q", "rank", "n", "lo", "hi"))
    answers = reduce(DataFrame.unionByName, found) if found else None
    out = per_key
    if answers is not None:
        wide = answers.groupBy("k").agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(f"q{i}") for i in range(len(quantiles))])
        out = out.join(wide, "k", "left")
    release(base)
    return out.withColumnRenamed("k", "key_value")


def heavy_keys(df: DataFrame, key: str, value: str, share: float = 0.02, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The keys that hold at least this share of all rows, with the statistics of key_stats."""
    return key_stats(df, key, value, quantiles, share)
