"""Dense indices for ids, without a global window in one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import cut, hint, release

#: Ids that one task numbers.
RANGE = 250_000


def index(*ids: tuple[DataFrame, str]) -> DataFrame:
    """id, idx: the distinct non-null ids of all given columns, numbered from 0 in byte order.

    Ids are sorted by ranges in parallel; each range starts at the number of ids before it.
    """
    all_ids = reduce(DataFrame.union, [df.select(F.col(c).cast("string").alias("id")) for df, c in ids]).dropna().distinct()
    ids = cut(all_ids)
    parts = max(1, -(-ids.count() // RANGE))
    ranged = cut(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()))
    release(ids)
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("c"))  # one row per range
    before = F.coalesce(F.sum("c").over(W.partitionBy(F.lit(1)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def number(pdf):
        pdf = pdf.sort_values("id", key=lambda s: s.map(str.encode), ignore_index=True)
        pdf["idx"] = pdf.index.astype("int64") + pdf["first"]
        return pdf[["id", "idx"]]

    return ranged.join(hint(sizes.select("p", before.alias("first"))), "p").groupBy("p").applyInPandas(number, "id string, idx bigint")


def known(df: DataFrame, column: str, mapping: DataFrame, to: str) -> DataFrame:
    """df with the index of a column; rows with unknown ids are left out."""
    m = mapping.select(F.col("id").alias("__id"), F.col("idx").alias(to))
    return df.join(m, F.col(column) == F.col("__id")).drop("__id")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; lengths are floored at 1e-12."""
    length = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return dot(a, b) / (length(a) * length(b))
