"""The N highest-scoring items of every group, by descending score bands."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import col, cut, release

#: Shares of all rows, from the top, at which score bands end; the last band holds the rest.
SHARES = (1 / 64, 1 / 16, 1 / 4)


def top_n(scores: DataFrame, group: str, item: str, score: str, n: int, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """group, item_rank (1..n), item: the n items of each group by descending score, equal scores by ascending item.

    Rows are (group, item, score), one per group and item. They are written once, by score band; equal scores never lie
    in two bands. Bands are processed from the top: groups that are already filled are taken out by an anti-join, the
    others take what they still need, exactly ranked. Ranking keeps n rows per group and task before its shuffle, so a
    group of any size is spread. Rows with a null group, item or score (or a NaN score) are left out; groups with fewer
    than n items give all; n = 0 and empty tables give none. A repeated row is another item of equal rank order, so
    callers aggregate first. Other columns are ignored.
    """
    base = scores.select(col(group).alias("g"), col(item).alias("i"), col(score).cast("double").alias("s")).dropna().filter(~F.isnan("s"))
    base = cut(base)
    ends = base.select(F.percentile_approx("s", [1 - x for x in shares], 2000)).first()[0] or []
    ends = sorted(set(ends), reverse=True)
    band = F.lit(len(ends))
    for k in reversed(range(len(ends))):
        band = F.when(F.col("s") >= ends[k], F.lit(k)).otherwise(band)
    banded = cut(base.withColumn("band", band), "band")
    release(base)
    order = W.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    picked: list[DataFrame] = []
    counted: list[DataFrame] = []
    for k in range(len(ends) + 1):
        rows = banded.filter(F.col("band") == k).select("g", "i", "s")
        if picked:
            taken = reduce(DataFrame.union, picked).groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("taken"))
            taken = cut(taken)
            counted.append(taken)
            rows = rows.join(taken.filter(F.col("taken") >= n).select("g"), "g", "left_anti")
        best = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
        if picked:
            best = best.join(taken.filter(F.col("taken") < n), "g", "left").withColumn("r", F.col("r") + F.coalesce("taken", F.lit(0))).filter(F.col("r") <= n)
        picked.append(cut(best.select("g", "r", "i")))
    release(banded, *counted)
    return reduce(DataFrame.union, picked).select(F.col("g").alias(group), F.col("r").alias("item_rank"), F.col("i").alias(item))
