"""Vector retrieval: exact, by random hyperplanes, and over stored 4-bit codes with exact rescoring."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.operators.linear import best_of
from veldt.operators.mappings import cosine as cosine_of
from veldt.session import cut, hint

#: Vectors of one block of items and of queries; every query block meets every item block as one group.
BLOCK = 4096
#: Queries whose scores are held at once.
SLICE = 512
#: Planes nearest to a query among which its further buckets are sought.
NEAR = 10


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _clean(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).dropna()


def pack_codes(items: DataFrame, cosine: bool = False) -> DataFrame:
    """id, v, code, low, step: each vector beside its 4-bit code, two entries a byte, to be stored and asked by top_k.

    An entry stands on one of 16 levels between the row's least and largest entry. With cosine the unit vector is coded.
    """

    def run(batches):
        for pdf in batches:
            x = _stack(pdf["v"])
            if not len(x):
                continue
            x = _unit(x) if cosine else x
            low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
            step = np.where(high > low, (high - low) / 15, 1.0)
            level = np.round((x - low) / step).astype(np.uint8)
            level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
            packed = level[:, ::2] | level[:, 1::2] << 4
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "code": [r.tobytes() for r in packed], "low": low[:, 0], "step": step[:, 0]})

    return _clean(items).mapInPandas(run, "id bigint, v array<double>, code binary, low double, step double")


def _unpacked(items: pd.DataFrame, size: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(items["code"]), np.uint8).reshape(len(items), -1)
    level = np.stack([packed & 15, packed >> 4], 2).reshape(len(items), -1)[:, :size]
    return level * items["step"].to_numpy()[:, None] + items["low"].to_numpy()[:, None]


def _top(items: pd.DataFrame, queries: pd.DataFrame, k: int, cosine: bool, codes: bool) -> pd.DataFrame:
    none = pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(items) or not len(queries):
        return none
    items = items.sort_values("id", ignore_index=True)
    a, b = _stack(queries["v"]), _stack(items["v"])
    rough = _unpacked(items, b.shape[1]) if codes else None
    if cosine:
        a, b = _unit(a), _unit(b)
    ids, asking, outs = items["id"].to_numpy(), queries["id"].to_numpy(), [none]
    for lo in range(0, len(a), SLICE):
        x = a[lo : lo + SLICE]
        if codes:  # the best by their codes are scored again
            s = x @ rough.T
            n = min(4 * k, s.shape[1])
            pick = np.argpartition(-s, n - 1, 1)[:, :n]
            exact = np.round(np.einsum("qd,qnd->qn", x, b[pick]), 9)
            s = np.full(s.shape, -np.inf)
            np.put_along_axis(s, pick, exact, 1)
        else:
            s = np.round(x @ b.T, 9)
        r, j, _ = best_of(s, k)
        outs.append(pd.DataFrame({"q": asking[lo + r], "id": ids[j], "score": s[r, j]}))
    return pd.concat(outs)


def top_k(queries: DataFrame, items: DataFrame, k: int, cosine: bool = False, codes: bool = False, exclude_self: bool = False) -> DataFrame:
    """query_id, rank, item_id, score: the k items of largest product (or cosine) for each query, equal ones by id.

    queries and items are (id bigint, v array). A stated query set meets all items in blocks of BLOCK on either side,
    each pair of blocks a group of its own; each block pair sends only its k best. With codes items are scanned as 4-bit
    codes, and 4 k candidates of each block are scored again exactly; items may be stored ones of pack_codes(). Nulls
    are left out.
    """
    a = _clean(queries)
    b = items if "code" in items.columns else pack_codes(items, cosine) if codes else _clean(items)
    if codes and "code" not in items.columns:
        b = cut(b)
    more = ["code", "low", "step"] if codes else []
    many = max(1, -(-b.count() // BLOCK)), max(1, -(-a.count() // BLOCK))
    want = k + 1 if exclude_self else k
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("qb", block(many[1])).withColumn("ib", every(many[0])).withColumn("ask", F.lit(True))
    for c, kind in zip(more, ("binary", "double", "double")):
        left = left.withColumn(c, F.lit(None).cast(kind))
    right = b.select("id", "v", *more).withColumn("ib", block(many[0])).withColumn("qb", every(many[1])).withColumn("ask", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _top(pdf[~pdf["ask"]], pdf[pdf["ask"]], want, cosine, codes)

    best = left.unionByName(right).groupBy("qb", "ib").applyInPandas(run, "q bigint, id bigint, score double")
    best = best.filter("q <> id") if exclude_self else best
    return _ranked(best, k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("item_id"), "score")


def hyperplane_top_k(queries: DataFrame, items: DataFrame, k: int, dim: int, bits: int | None = None, tables: int = 8, seed: int = 7, probes: int | None = None) -> DataFrame:
    """As top_k by cosine, among items in the `probes` nearest hash buckets of a query in one of the tables: approximate.

    A hash is the signs of `bits` random hyperplanes; by default 8, or more so that a bucket keeps about 64 items. A
    query probes the buckets that it is least far from, by the summed distance to the hyperplanes in between, its own
    first; by default an eighth of the buckets, 32 at most, so a query meets a bounded number of items. Hash buckets are
    equi-join keys; a pair that meets in several tables counts once.
    """
    a, b = _clean(queries), _clean(items)
    bits = max(8, math.ceil(math.log2(max(b.count(), 1) / 64 + 1))) if bits is None else bits
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    weights = (1 << np.arange(bits)).astype(np.int64)
    near = min(bits, NEAR)
    flips = (np.arange(1 << near)[:, None] >> np.arange(near) & 1).astype(np.int64)
    probes = max(1, min((1 << bits) // 8, 32)) if probes is None else min(probes, 1 << near)

    def sign(n):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    far = (_stack(pdf["v"]) @ planes.T).reshape(len(pdf), tables, bits)
                    h = ((far > 0) @ weights + np.arange(tables) * (1 << bits))[:, :, None]
                    if n > 1:
                        ways = []
                        for t in range(tables):
                            gap = np.abs(far[:, t])
                            which = np.argsort(gap, 1, kind="stable")[:, :near]
                            cost = np.take_along_axis(gap, which, 1) @ flips.T
                            best = np.argsort(cost, 1, kind="stable")[:, :n]
                            ways.append((flips[best] * weights[which][:, None]).sum(2))
                        h = h ^ np.stack(ways, 1)
                    yield pd.DataFrame({"id": pdf["id"].repeat(tables * n).to_numpy(), "h": h.ravel()})

        return run

    x = a.mapInPandas(sign(probes), "id bigint, h bigint").withColumnRenamed("id", "q")
    y = b.mapInPandas(sign(1), "id bigint, h bigint")
    pairs = x.join(y, "h").select("q", "id").distinct()
    scored = pairs.join(hint(a.select(F.col("id").alias("q"), F.col("v").alias("a"))), "q").join(hint(b.select("id", F.col("v").alias("b"))), "id")
    return _ranked(scored.select("q", "id", F.round(cosine_of(F.col("a"), F.col("b")), 9).alias("score")), k)


def mean_recall(approximate: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that were found, averaged over queries; 1 without any."""
    row = query_recall(approximate, exact).agg(F.avg("recall")).first()[0]
    return 1.0 if row is None else float(row)


def query_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of its exact neighbours that were found."""
    truth = exact.select("query_id", "item_id")
    found = truth.join(approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return found.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
