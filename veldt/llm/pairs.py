"""Items that appear together: counts and association of item pairs over baskets.

A pair is one 64-bit code of two dense item numbers. Baskets become sorted runs of codes, counted by run length before
anything moves; Spark's sort then spills and merges the runs of each code range, and a second run-length pass sums them.
The few largest baskets send no pairs: a pair needs `support` common baskets, and fewer than `support` baskets are set
apart, so every pair that qualifies also occurs in another basket; what the large ones add is looked up per item.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import col, cut, hint, release

#: Codes held in one run before it is sorted and counted (8 bytes each).
RUN = 4_000_000
#: Baskets of more items are cut into blocks, and pairs of blocks are spread over tasks.
BLOCK = 256
#: Large baskets that are set apart, at most.
LARGE = 64
#: Items that one task numbers.
RANGE = 250_000


def _runs(batches):
    """Rows (left, right) of sorted item numbers (right null: pairs within left) into run-length counted code runs."""
    held, rows = [], 0

    def flush():
        codes = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(np.diff(np.r_[first, len(codes)]))], ["code", "n"])

    def lists(column):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, np.diff(column.offsets.to_numpy()).astype(np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        cross = b["right"].is_valid().to_numpy(zero_copy_only=False)
        flat, size = lists(b["left"].filter(pa.array(~cross)))
        start = np.r_[0, np.cumsum(size)[:-1]]
        for n in np.unique(size[size > 1]):
            a, c = np.triu_indices(n, 1)
            at = start[size == n]
            for k in range(0, len(at), step := max(1, RUN // len(a))):
                items = flat[at[k : k + step, None] + np.arange(n)]
                held.append(((items[:, a] << 32) | items[:, c]).ravel())
                rows += len(held[-1])
                if rows >= RUN:
                    yield flush()
                    held, rows = [], 0
        if cross.any():
            for x, y in zip(b["left"].filter(pa.array(cross)).to_pylist(), b["right"].filter(pa.array(cross)).to_pylist()):
                x, y = np.array(x, np.int64)[:, None], np.array(y, np.int64)[None, :]
                held.append(((np.minimum(x, y) << 32) | np.maximum(x, y)).ravel())
                rows += len(held[-1])
                if rows >= RUN:
                    yield flush()
                    held, rows = [], 0
    if held:
        yield flush()


def _merge(least: int):
    """Sums runs of equal codes in a sorted stream; keeps codes with at least this count."""

    def run(batches):
        code, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            c, n = b["code"].to_numpy(), b["n"].to_numpy()
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            keys, sums = c[first], np.add.reduceat(n, first)
            if keys[0] == code:
                sums[0] += count
            elif code is not None and count >= least:
                yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["code", "n"])
            code, count = int(keys[-1]), int(sums[-1])
            keys, sums = keys[:-1], sums[:-1]
            keep = sums >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(sums[keep])], ["code", "n"])
        if code is not None and count >= least:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["code", "n"])

    return run


def pair_association(rows: DataFrame, basket: str, item: str, support: int = 10, min_lift: float = 0.0) -> DataFrame:
    """item_a < item_b with n_a, n_b, n_ab, n_baskets, lift, odds_ratio and log_odds: pairs with n_ab >= support.

    A basket holds an item once, however often the row is repeated; rows with a null basket or item are left out; an
    empty table gives no pair, and n_baskets counts the baskets that hold any item. lift is n_ab * N / (n_a * n_b), and
    pairs with n_ab * N < min_lift * n_a * n_b are left out. The odds ratio of the 2x2 table carries the continuity
    correction of one half in each cell, so it is always finite. Items order by their bytes. Other columns are ignored.
    """
    support = max(1, support)
    base = cut(rows.select(col(basket).alias("b"), col(item).alias("i")).dropna().distinct())
    counts = cut(base.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support))
    sizes = cut(base.groupBy("b").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.count()
    # An item needs `support` baskets itself. Dense numbers in byte order: ranges sorted in parallel, then numbered.
    numbered = cut(_dense(counts))
    release(counts)
    # The largest baskets by size, numbered: fewer than `support`, and no more than LARGE (blocks take any others).
    large = cut(sizes.filter(F.col("size") > BLOCK).orderBy(F.col("size").desc(), "b").limit(min(support - 1, LARGE)).select("b", F.monotonically_increasing_id().alias("j")))
    n_large = large.count()
    coded = base.join(hint(numbered.select("i", "k")), "i").select("b", "k")
    # Baskets of more than BLOCK items are collected in blocks, never whole.
    wide = cut(sizes.filter(F.col("size") > BLOCK).join(F.broadcast(large), "b", "left_anti").select("b", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")))
    release(sizes)
    lists = coded.join(F.broadcast(large), "b", "left_anti")
    lists = lists.join(hint(wide), "b", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")))
    lists = lists.groupBy("b", "part").agg(F.sort_array(F.collect_list("k")).alias("left"))
    inner = lists.select("left", F.lit(None).cast("array<int>").alias("right"))
    if not wide.isEmpty():
        blocks = cut(lists.join(hint(wide.select("b")), "b", "left_semi"))
        both = blocks.join(blocks.select("b", F.col("part").alias("other"), F.col("left").alias("right")), "b").filter("part < other")
        inner = inner.union(both.select("left", "right").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))
    runs = inner.mapInArrow(_runs, "code bigint, n bigint")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    merged = runs.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_merge(max(1, support - n_large)), "code bigint, n bigint")
    pairs = merged.select(F.shiftright("code", 32).cast("int").alias("ka"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("kb"), "n")
    # What the large baskets add: for each item the numbers of the large baskets that hold it, fewer than `support`.
    held = coded.join(F.broadcast(large), "b").groupBy("k").agg(F.collect_list("j").alias("held"))
    ends = numbered.select("k", F.col("i").alias("item"), F.col("n").alias("ni")).join(hint(held), "k", "left")
    ends = hint(cut(ends.withColumn("held", F.coalesce("held", F.array().cast("array<bigint>")))))
    for s in "ab":
        pairs = pairs.join(ends.select(F.col("k").alias(f"k{s}"), F.col("item").alias(f"item_{s}"), F.col("ni").alias(f"n_{s}"), F.col("held").alias(f"l{s}")), f"k{s}")
    both_large = F.size(F.array_intersect("la", "lb")) if n_large else F.lit(0)
    pairs = pairs.withColumn("n_ab", F.col("n") + both_large.cast("bigint")).filter(F.col("n_ab") >= support)
    a, b, ab, t = F.col("n_a"), F.col("n_b"), F.col("n_ab"), F.lit(total)
    pairs = pairs.filter(ab * t >= F.lit(min_lift) * a * b)
    odds = (ab + 0.5) * (t - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", t.cast("bigint").alias("n_baskets"), (ab * t / (a * b)).alias("lift"), odds.alias("odds_ratio"), F.log(odds).alias("log_odds"))


def _dense(counts: DataFrame) -> DataFrame:
    """i, n, k: k numbers the items from 0 in their order, in ranges of about RANGE items each."""
    parts = max(1, -(-counts.count() // RANGE))
    ranged = cut(counts.repartitionByRange(parts, "i").sortWithinPartitions("i").withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("c"))  # one row per range
    before = F.coalesce(F.sum("c").over(W.partitionBy(F.lit(1)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", key=lambda s: s.map(lambda x: x.encode() if isinstance(x, str) else x), ignore_index=True)
        return pd.DataFrame({"i": pdf["i"], "n": pdf["n"], "k": (np.arange(len(pdf)) + pdf["before"].to_numpy()).astype("int32")})

    firsts = sizes.select("p", before.alias("before"))
    return ranged.join(hint(firsts), "p").groupBy("p").applyInPandas(number, f"i {dict(counts.dtypes)['i']}, n bigint, k int")
