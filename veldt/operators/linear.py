"""Closed-form linear item model with side features.

Gram blocks are distributed aggregations over symmetric halves, with large groups salted; the dense inverse runs in one
worker task behind a check of its memory. Blocks do not depend on alpha, beta, lambda or the metadata weight, so a search
computes them once. Scoring multiplies packed user rows with one block of targets at a time inside the workers, masks and
cuts to the k best there, so only k rows a user and block ever move.
"""

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.functions.features import Transform
from veldt.session import cut, hint, release, spread

#: Bytes that the three dense matrices of a solve may take; above WHOLE_BYTES items are first parted into components.
SOLVE_BYTES, WHOLE_BYTES = 3_000_000_000, 1_000_000_000
#: Bytes of one of the tables (items times features of users and items) that a bordered solve keeps beside its components.
BORDER_BYTES = 64_000_000
#: Ids that the driver lists, and users of one component that a task scores.
MOST_IDS, USERS = 2_000_000, 20_000
#: Bytes of the weights of one block of targets, as sent to the workers.
BLOCK_BYTES = 64_000_000
#: Pairs that one task may make of one group of a Gram join; larger groups are salted.
GROUP_PAIRS = 4_000_000
#: Of a model with a border: bytes of the Gram rows that a task fills at a time, and pairs of items that it adds to them.
TILE_BYTES, TILE_PAIRS = 64_000_000, 100_000_000
#: Bytes of one piece of a matrix that is turned or carried between driver and workers, and rows taken at once.
PIECE_BYTES, SLICE = 16_000_000, 256
#: What an item that is not eligible gets on top of its score.
NOT_ELIGIBLE = -1e9


def _paired(x: DataFrame, y: DataFrame) -> DataFrame:
    """x and y joined on b. The x rows of a group with very many pairs are spread over salts, its y rows repeated for each."""
    sizes = x.groupBy("b").agg(F.count(F.lit(1)).alias("nx")).join(y.groupBy("b").agg(F.count(F.lit(1)).alias("ny")), "b")
    salts = F.least("nx", F.ceil(F.col("nx") * F.col("ny") / GROUP_PAIRS))
    heavy = cut(sizes.select("b", salts.cast("int").alias("salts")).filter("salts > 1"))
    if heavy.isEmpty():
        return x.join(y, "b")
    heavy, many = hint(heavy), F.coalesce("salts", F.lit(1))
    x = x.join(heavy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("i"), many).cast("int")).drop("salts")
    y = y.join(heavy, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    return x.join(y, ["b", "salt"]).drop("salt")


def _reading(out: DataFrame, *tables: DataFrame) -> DataFrame:
    """out, which remembers the cut tables it reads, so that a caller who has written it can delete them."""
    out._veldt_reads = tables
    return out


def gram(left: DataFrame, by: str, key: str, value: str = "value") -> DataFrame:
    """i <= j, g: sums over `by` of the products of values of two keys. Duplicates are summed first."""
    x = cut(left.groupBy(F.col(by).alias("b"), F.col(key).alias("i")).agg(F.sum(value).alias("v")))
    y = x.select("b", F.col("i").alias("j"), F.col("v").alias("w"))
    return _reading(_paired(x, y).filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("g")), x)


def cross_gram(left: DataFrame, left_key: str, right: DataFrame, right_key: str, by: str, value: str = "value") -> DataFrame:
    """i, j, g: sums over `by` of the products of a left key's and a right key's values."""
    x = cut(left.groupBy(F.col(by).alias("b"), F.col(left_key).alias("i")).agg(F.sum(value).alias("v")))
    y = cut(right.groupBy(F.col(by).alias("b"), F.col(right_key).alias("j")).agg(F.sum(value).alias("w")))
    return _reading(_paired(x, y).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("g")), x, y)


@dataclass
class Blocks:
    """xtx, ttt, xtu, utu as (block, i, j, g) over the places of items and, after them, features; their ids in order.

    tags: where the model has many items and is solved with a border or has no features, how many features the items have;
    then block t (i an item, j its feature, from 0) stands for ttt, which would connect all items that share one, and xtu and
    xtx stand in packed: (part, r, w), for item r its xtu of all features, then its xtx of itself and the items after it in
    its component, summed over the rows of one r. label: the components (the least place of each) that users make of the items.
    """

    cells: DataFrame
    items: list[str]
    features: list[str]
    tags: int | None = None
    packed: DataFrame | None = None
    label: np.ndarray | None = None


def blocks(interactions: DataFrame, user_features: DataFrame | None = None, item_features: DataFrame | None = None, items: list[str] | None = None, features: list[str] | None = None) -> Blocks:
    """The four Gram blocks. Items come from interactions and item features, and are counted before they are listed."""
    spark = interactions.sparkSession
    x = interactions.select(F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.col("value").cast("double")).dropna()
    u = user_features.select(F.col("user_id").cast("string"), "feature_name", F.col("value").cast("double")).dropna() if user_features is not None else None
    t = item_features.select(F.col("item_id").cast("string"), "feature_name", F.col("value").cast("double")).dropna() if item_features is not None else None
    ids = x.select("item_id")
    ids = ids.union(t.select("item_id")) if t is not None else ids
    if items is None:
        items = _listed(ids)
    if features is None:
        features = _listed(u.select("feature_name")) if u is not None else []
    at = lambda df, names, name, first: df.join(F.broadcast(places(spark, names, name, first)), name)
    x = at(x, items, "item_id", 0)
    tags, parts = _border(t, items, features), {}
    if tags is None:
        parts["xtx"] = gram(x, "user_id", "k")
    if tags:
        marked = at(t, items, "item_id", 0).withColumnRenamed("k", "i")
        parts["t"] = _reading(at(marked, tags, "feature_name", 0).groupBy("i", F.col("k").alias("j")).agg(F.sum("value").alias("g")))
    elif t is not None:
        parts["ttt"] = gram(at(t, items, "item_id", 0), "feature_name", "k")
    if u is not None:
        u = at(u, features, "feature_name", len(items))
        if tags is None:
            parts["xtu"] = cross_gram(x, "k", u, "k", "user_id")
        parts["utu"] = gram(u, "user_id", "k")
    empty = [] if parts else [spark.createDataFrame([], "block string, i int, j int, g double")]
    cells = cut(reduce(DataFrame.unionByName, [p.select(F.lit(b).alias("block"), "i", "j", "g") for b, p in parts.items()] + empty))
    packed = label = None
    if tags is not None:
        packed, label = _packed_gram(x, parts["utu"]._veldt_reads[0] if u is not None else None, items, len(features))
    release(*[t for p in parts.values() for t in p._veldt_reads])
    return Blocks(cells, items, features, None if tags is None else len(tags), packed, label)


def _border(t: DataFrame | None, items: list[str], features: list[str]) -> list[str] | None:
    """The names of item features if there are many items and, with the users', few features or none; None if not."""
    n, most = len(items) + len(features), BORDER_BYTES // (8 * max(len(items), 1)) - len(features)
    if 24 * n * n <= WHOLE_BYTES or most < 0:
        return None
    tags = [r[0] for r in t.select("feature_name").distinct().limit(most + 1).collect()] if t is not None else []
    return sorted(tags, key=str.encode) if len(tags) <= most else None


def _layout(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of labelled places: all, members of a component side by side by place; where the component of each begins there; the
    spot of each in its component."""
    order = np.argsort(label, kind="stable").astype(np.int32)
    first = np.searchsorted(label[order], label)
    spot = np.empty(len(label), np.int64)
    spot[order] = np.arange(len(label))
    return order, first, spot - first


def _packed_gram(x: DataFrame, u: DataFrame | None, items: list[str], p: int) -> tuple[DataFrame, np.ndarray]:
    """Blocks.packed and its label, from interactions (user_id, k, value) and the summed features (b, i, v) of users.

    A task fills the dense rows of a component, or of a tile of one, user by user, so that sums and not pairs are shuffled.
    Components with very many pairs are spread over salts by user.
    """
    m, spark = len(items), x.sparkSession
    lists = lambda df, i, v: df.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("b", F.col("x.i").alias(i), F.col("x.v").alias(v))
    none = lambda c, kind: F.coalesce(c, F.array()).cast(f"array<{kind}>").alias(c)
    sums = cut(x.groupBy(F.col("user_id").alias("b"), F.col("k").alias("i")).agg(F.sum("value").alias("v")))
    users = lists(sums, "at", "v")
    if u is not None:
        users = users.join(lists(u.withColumn("i", F.col("i") - m), "f", "fv"), "b", "left")
    else:
        users = users.withColumns({"f": F.lit(None).cast("array<int>"), "fv": F.lit(None).cast("array<double>")})
    users = cut(users.select(F.xxhash64("b").alias("h"), "at", "v", none("f", "int"), none("fv", "double")))
    label = components(users.select(F.element_at("at", 1).alias("i"), F.explode("at").alias("j")), m)
    order, first, spot = _layout(label)
    size = np.bincount(label, minlength=m)
    high = np.maximum(1, TILE_BYTES // (8 * np.maximum(size + p, 1)))  # rows of a tile
    salts = np.ones(m, np.int64)

    def pairs(batches):
        for b in batches:
            at, start = _lists(b["at"])
            n = np.bincount(label[at[start[:-1]]], np.diff(start).astype(float) ** 2, m)
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["part", "n"])

    for part, n in users.select("at").mapInArrow(pairs, "part int, n double").groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") > TILE_PAIRS).collect():
        salts[part] = np.ceil(n / max(TILE_PAIRS, 8 * int(size[part]) ** 2))

    def routed(batches):
        for b in batches:
            at, start = _lists(b["at"])
            row = np.repeat(np.arange(b.num_rows), np.diff(start))
            part = label[at]
            tile = spot[at] // high[part]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])][: len(at)])
            row, part = row[new], part[new]
            salt = b["h"].to_numpy()[row] % salts[part]
            columns = [pa.array(c.astype(np.int32)) for c in (part, tile[new], salt)] + [b[c].take(pa.array(row)) for c in ("at", "v", "f", "fv")]
            yield pa.RecordBatch.from_arrays(columns, ["part", "tile", "salt", "at", "v", "f", "fv"])

    def rows(key, g):
        part, low = key[0], key[1] * high[key[0]]
        for lo in range(0, len(g), SLICE):
            w = [x for k in range(lo, min(lo + SLICE, len(g))) for x in (g[k, :p], g[k, p + k :])]
            ends = np.cumsum([len(x) for x in w])[1::2]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(w)))
            r = order[first[part] + low + lo + np.arange(len(ends))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part, np.int32)), pa.array(r), lists], ["part", "r", "w"])

    def filled(batches):
        key, low, g = None, 0, None
        for b in batches:
            (at, start), (v, _), (f, f_start), (fv, _) = (_lists(b[c]) for c in ("at", "v", "f", "fv"))
            at, keys = spot[at], list(zip(*(b[c].to_pylist() for c in ("part", "tile", "salt"))))
            for k, now in enumerate(keys):
                if now != key:
                    if key is not None:
                        yield from rows(key, g)
                    key, wide = now, int(size[now[0]])
                    low = now[1] * int(high[now[0]])
                    g = np.zeros((min(int(high[now[0]]), wide - low), p + wide - low))
                mine, value = at[start[k] : start[k + 1]] - low, v[start[k] : start[k + 1]]
                lo, hi = np.searchsorted(mine, (0, len(g)))
                other = slice(f_start[k], f_start[k + 1])
                columns, values = np.concatenate((f[other], p + mine[lo:])), np.concatenate((fv[other], value[lo:]))
                g[mine[lo:hi, None], columns] += value[lo:hi, None] * values
        if key is not None:
            yield from rows(key, g)

    every = places(spark, items, "item_id").select(F.lit(0).cast("bigint").alias("h"), F.array("k").alias("at"), F.array(F.lit(0.0)).alias("v"), F.array().cast("array<int>").alias("f"), F.array().cast("array<double>").alias("fv"))  # items without any user
    kinds = "part int, tile int, salt int, at array<int>, v array<double>, f array<int>, fv array<double>"
    by = ["part", "tile", "salt"]
    packed = cut(users.unionByName(every).mapInArrow(routed, kinds).repartition(*by).sortWithinPartitions(*by).mapInArrow(filled, "part int, r int, w array<double>"))
    release(sums, users)
    return packed, label


def _unpacked(b: Blocks) -> Blocks:
    """Blocks with xtx, xtu and ttt as cells, for a solve without a border."""
    p, m = len(b.features), len(b.items)
    order, first, spot = _layout(b.label)
    shared = b.cells.sparkSession.sparkContext.broadcast((order, first + spot))

    def run(batches):
        order, begin = shared.value
        for x in batches:
            w, start = _lists(x["w"])
            for k, r in enumerate(x["r"].to_pylist()):
                row = w[start[k] : start[k + 1]]
                j = np.concatenate((m + np.arange(p), order[begin[r] : begin[r] + len(row) - p])).astype(np.int32)
                some = np.flatnonzero(row != 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(some < p, "xtu", "xtx").tolist(), pa.string()), pa.array(np.full(len(some), r, np.int32)), pa.array(j[some]), pa.array(row[some])], ["block", "i", "j", "g"])

    cells = b.cells.filter("block <> 't'").unionByName(b.packed.mapInArrow(run, "block string, i int, j int, g double").groupBy("block", "i", "j").agg(F.sum("g").alias("g")))
    if b.tags:
        cells = cells.unionByName(gram(b.cells.filter("block = 't'"), "j", "i", "g").select(F.lit("ttt").alias("block"), "i", "j", "g"))
    return Blocks(cut(cells), b.items, b.features)


def places(spark, names: list[str], name: str, first: int = 0) -> DataFrame:
    """name, k: ids with their places. Models are bounded by the solve, so the table is small enough to broadcast."""
    return spark.createDataFrame(pd.DataFrame({name: pd.Series(names, dtype=object), "k": np.arange(first, first + len(names), dtype=np.int32)}), f"`{name}` string, k int")


def _listed(ids: DataFrame) -> list[str]:
    found = [r[0] for r in ids.distinct().limit(MOST_IDS + 1).collect()]
    if len(found) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids")
    return sorted(found, key=str.encode)


def _hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the least place of each component) after further pairs."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def components(cells: DataFrame, n: int) -> np.ndarray:
    """For each of n places the least place that the pairs (i, j) connect it to. The inverse is zero between components."""

    def forest(batches):
        label = np.arange(n)
        for b in batches:
            label = _hooked(label, b["i"].to_numpy(), b["j"].to_numpy())
        k = np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(label[k].astype(np.int32))], ["i", "j"])

    pairs = cells.filter("i <> j").select("i", "j").mapInArrow(forest, "i int, j int")
    t = pairs.repartition(1).mapInArrow(forest, "i int, j int").toArrow()
    return _hooked(np.arange(n), t["i"].to_numpy(), t["j"].to_numpy())


def dense_gram(cells: Iterable[pd.DataFrame], n: int, alpha: float, beta: float, meta_weight: float) -> np.ndarray:
    """The symmetric matrix of so many places, filled batch by batch; a cell stands in one batch only."""
    g = np.zeros((n, n))
    for batch in cells:
        _add_cells(g, batch, alpha, beta, meta_weight)
    return g


def _add_cells(g: np.ndarray, batch: pd.DataFrame, alpha: float, beta: float, meta_weight: float) -> None:
    w = meta_weight if meta_weight > 0 else 1.0
    scale = {"xtx": 1.0, "ttt": w * alpha * alpha, "xtu": beta, "utu": beta * beta, "none": 0.0}
    for block, part in batch.groupby("block"):
        i, j, v = part["i"].to_numpy(), part["j"].to_numpy(), part["g"].to_numpy() * scale[block]
        g[i, j] += v
        off = i != j
        g[j[off], i[off]] += v[off]


def closed_form(g: np.ndarray, lam: float, threshold: float = 0.0) -> np.ndarray:
    """S = -P / diag(P) by column with a zero diagonal, P the inverse of G + lambda I; small entries pruned."""
    p = np.linalg.inv(g + lam * np.eye(len(g)))
    d = np.diag(p)
    s = p * np.where(np.abs(d) > 1e-12, -1.0 / np.where(d == 0, 1, d), 0.0)
    np.fill_diagonal(s, 0.0)
    if threshold > 0:
        s[np.abs(s) < threshold] = 0.0
    return s


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column, and where each row starts."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]


def sliced(batches) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Batches of rows (r, w) as (places, matrix), SLICE rows at a time."""
    for b in batches:
        flat, start = _lists(b["w"])
        r = b["r"].to_numpy()
        for lo in range(0, len(r), SLICE):
            hi = min(lo + SLICE, len(r))
            yield r[lo:hi], flat[start[lo] : start[hi]].reshape(hi - lo, -1)


def _runs(batches) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of rows (r, w) or (r, at, w) as (places, matrix, places of its columns), of one component and SLICE rows at most."""
    for b in batches:
        if "at" not in b.schema.names:
            for r, a in sliced([b]):
                yield r, a, np.arange(a.shape[1])
            continue
        r, (flat, start), (at, _) = b["r"].to_numpy(), _lists(b["w"]), _lists(b["at"])
        heads = at[start[:-1]]
        edges = np.r_[0, np.flatnonzero(heads[1:] != heads[:-1]) + 1, len(r)] if len(r) else np.zeros(0, int)
        for a, e in zip(edges[:-1], edges[1:]):
            for lo in range(a, e, SLICE):
                hi = min(lo + SLICE, e)
                yield r[lo:hi], flat[start[lo] : start[hi]].reshape(hi - lo, -1), at[start[lo] : start[lo + 1]]


def row_batch(r: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """(r, w) from places and a matrix."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(r, np.int32)), lists], ["r", "w"])


def transposed(rows: DataFrame, height: int) -> DataFrame:
    """Rows (r, w) of a matrix of so many rows into (r, w) of its columns; a missing row counts as zeros.

    A task holds PIECE_BYTES of the result at a time.
    """
    wide = max(1, PIECE_BYTES // (8 * max(height, 1)))

    def pieces(batches):
        for r, a in sliced(batches):
            for lo in range(0, a.shape[1], wide):
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([r.tolist()], pa.list_(pa.int32())), pa.array([a[:, lo : lo + wide].tobytes()], pa.binary())], ["first", "at", "data"])

    def assemble(t: pa.Table) -> pa.Table:
        first, at, data = (t[c].to_pylist() for c in t.column_names)
        out = np.zeros((len(data[0]) // (8 * len(at[0])), height))
        for r, d in zip(at, data):
            out[:, r] = np.frombuffer(d).reshape(len(r), -1).T
        return pa.Table.from_batches([row_batch(first[0] + np.arange(len(out)), out)])

    return rows.select("r", "w").mapInArrow(pieces, "first int, at array<int>, data binary").groupBy("first").applyInArrow(assemble, "r int, w array<double>")


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place from 0) of the k best of each row, equal ones by column; -inf is never taken."""
    k = min(k, s.shape[1])
    if k < 1 or not len(s):
        return (np.zeros(0, int),) * 3
    least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
    r, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    order = np.lexsort((j, -s[r, j], r))
    r, j = r[order], j[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], j[nth < k], nth[nth < k]


def _score_block(shared, sources: int, k: int | None, exclude_seen: bool, digits: int | None):
    """Packed users against the targets of one block: user_id, rank, k, score, the k best or (k null) all."""

    def run(batches):
        first, weights, extra = shared.value  # weights: one row per source, one column per target
        width = weights.shape[1]
        for b in batches:
            users, rho = b["user_id"], b["rho"].to_numpy(zero_copy_only=False)
            (at, start), (value, _), (seen, seen_start) = (_lists(b[c]) for c in ("at", "v", "seen"))
            for lo in range(0, b.num_rows, 512):
                hi = min(lo + 512, b.num_rows)
                n, span = hi - lo, slice(start[lo], start[hi])
                if (start[hi] - start[lo]) * 8 > n * sources:  # dense rows: one product
                    z = np.zeros((n, sources))
                    z[np.repeat(np.arange(n), np.diff(start[lo : hi + 1])), at[span]] = value[span]
                    s = z @ weights
                else:
                    s = np.empty((n, width))
                    for r in range(n):
                        a, e = start[lo + r], start[lo + r + 1]
                        s[r] = value[a:e] @ weights[at[a:e]]
                # Items a user has seen, as far as they lie in this block.
                row = np.repeat(np.arange(n), np.diff(seen_start[lo : hi + 1]))
                item = seen[seen_start[lo] : seen_start[hi]] - first
                here = (item >= 0) & (item < width)
                row, item = row[here], item[here].astype(int)
                s[row, item] -= rho[lo:hi][row]
                if extra is not None:
                    s += extra
                if digits is not None:
                    s = np.round(s, digits) + 0.0
                if exclude_seen:
                    s[row, item] = -np.inf
                r, j, nth = best_of(s, width if k is None else k)
                yield pa.RecordBatch.from_arrays([users.take(pa.array(lo + r)), pa.array((nth + 1).astype(np.int32)), pa.array((j + first).astype(np.int32)), pa.array(s[r, j])], ["user_id", "rank", "k", "score"])

    return run


@dataclass
class LinearModel:
    """rows: (r, w), for each item r the weights of all items and, after them, features; z uses beta times feature values.

    transform tells how raw columns become features, for recommend_raw.
    """

    rows: DataFrame
    items: list[str]
    features: list[str]
    beta: float = 1.0
    transform: Transform | None = None

    @property
    def spark(self):
        return self.rows.sparkSession

    def item_frame(self) -> DataFrame:
        return places(self.spark, self.items, "item_id").withColumnRenamed("k", "item_idx")

    def _long(self) -> DataFrame:
        if self.parted:
            return self.rows.select("r", F.explode(F.arrays_zip(F.col("at").alias("c"), "w")).alias("x")).select("r", "x.c", "x.w")
        return self.rows.select("r", F.posexplode("w").alias("c", "w"))

    def _whole_rows(self) -> DataFrame:
        """Rows in which no weight is missing but zeros."""
        return self.rows

    @property
    def parted(self) -> bool:
        """Whether rows hold the weights of their own component only: (r, at, w), w at the places `at`, all others zero."""
        return "at" in self.rows.columns

    def dense_rows(self) -> DataFrame:
        """(r, w) with the weights of all items and features in every row."""
        if not self.parted:
            return self.rows.select("r", "w")
        n = len(self.items) + len(self.features)

        def run(batches):
            for r, a, at in _runs(batches):
                for lo in range(0, len(r), 16):
                    w = np.zeros((len(r[lo : lo + 16]), n))
                    w[:, at] = a[lo : lo + 16]
                    yield row_batch(r[lo : lo + 16], w)

        return self.rows.mapInArrow(run, "r int, w array<double>")

    @property
    def weights(self) -> DataFrame:
        """r, c, w: r an item (target), c `i:` item or `f:` feature (source); zero weights are left out."""
        sources = places(self.spark, [f"i:{x}" for x in self.items] + [f"f:{x}" for x in self.features], "source")
        targets = places(self.spark, self.items, "target").withColumnRenamed("k", "r")
        rows = self._long().filter("w <> 0 or isnan(w)").join(F.broadcast(sources.withColumnRenamed("k", "c")), "c").join(F.broadcast(targets), "r")
        return rows.select(F.col("target").alias("r"), F.col("source").alias("c"), "w")

    def _packed(self, interactions: DataFrame, features: DataFrame | None, seen: DataFrame | None, users: DataFrame | None, rho: float | DataFrame) -> DataFrame:
        """One row per user: places and summed values of what they used, places of what they have seen, and their penalty."""
        user = F.col("user_id").cast("string").alias("user_id")
        none = F.lit(None).cast("double").alias("v")
        item = F.concat(F.lit("i:"), F.col("item_id").cast("string")).alias("source")
        z = interactions.select(user, item, F.col("value").cast("double").alias("v"), F.lit(True).alias("old"))
        if features is not None:
            z = z.union(features.select(user, F.concat(F.lit("f:"), F.col("feature_name")), F.col("value").cast("double") * self.beta, F.lit(False)))
        if seen is not None:
            z = z.union(seen.select(user, item, none, F.lit(True)))
        if users is not None:
            z = z.union(users.select(user, F.lit(None).cast("string"), none, F.lit(False)))
        sources = places(self.spark, [f"i:{x}" for x in self.items] + [f"f:{x}" for x in self.features], "source")
        z = z.filter("user_id is not null").join(F.broadcast(sources), "source", "left")
        z = z.groupBy("user_id", "k").agg(F.sum(F.when(~F.isnan("v"), F.col("v"))).alias("v"), F.max("old").alias("old"))
        used = F.collect_list(F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), F.struct("k", "v")))
        z = z.groupBy("user_id").agg(used.alias("x"), F.collect_list(F.when(F.col("old"), F.col("k"))).alias("seen"))
        z = z.select("user_id", F.col("x.k").alias("at"), F.col("x.v").alias("v"), "seen")
        if isinstance(rho, (int, float)):
            return z.withColumn("rho", F.lit(float(rho)))
        return z.join(hint(rho.select(user, F.col("rho").cast("double").alias("rho"))), "user_id", "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))

    def _ranked(self, packed: DataFrame, k: int | None, exclude_seen: bool, mask: DataFrame | None, digits: int | None) -> DataFrame:
        n = len(self.items) + len(self.features)
        width = max(1, BLOCK_BYTES // (8 * max(n, 1)))
        lows = range(0, max(len(self.items), 1), width)
        packed = cut(packed) if len(lows) > 1 else packed
        allowed = None
        if mask is not None:
            allowed = np.full(len(self.items), NOT_ELIGIBLE)
            m = mask.select(F.col("item_id").cast("string").alias("item_id"), F.col("mask").cast("double").alias("mask")).join(F.broadcast(places(self.spark, self.items, "item_id")), "item_id").groupBy("k").agg(F.max("mask").alias("mask")).toPandas()
            allowed[m["k"]] = (m["mask"].fillna(0.0).to_numpy() - 1.0) * -NOT_ELIGIBLE
        if self.parted:
            return self._ranked_parts(packed, k, exclude_seen, allowed, digits)
        out = None
        for lo in lows:
            # One block of the bounded model at a time: BLOCK_BYTES at most.
            t = self.rows.filter(F.col("r").between(lo, lo + width - 1)).orderBy("r").toArrow()
            flat = t["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
            block = np.ascontiguousarray(flat.reshape(t.num_rows, n).T)
            shared = self.spark.sparkContext.broadcast((lo, block, allowed[lo : lo + width] if allowed is not None else None))
            part = packed.mapInArrow(_score_block(shared, n, k, exclude_seen, digits), "user_id string, rank int, k int, score double")
            out = part if out is None else out.unionByName(part)
        if len(lows) > 1:
            out = rank_top(out.drop("rank"), k if k is not None else len(self.items), item="k")
        return out.join(F.broadcast(places(self.spark, self.items, "item_id")), "k").select("user_id", "rank", "item_id", "score")

    def _ranked_parts(self, packed: DataFrame, k: int | None, exclude_seen: bool, allowed: np.ndarray | None, digits: int | None) -> DataFrame:
        """_ranked() by components: users meet the weights of those they have used or seen something of; all other items
        have no weight for them, so the first of these are candidates with what the mask adds."""
        m, n, k = len(self.items), len(self.items) + len(self.features), len(self.items) if k is None else k
        parts = self.rows.groupBy(F.element_at("at", 1).alias("part")).agg(F.first("at").alias("at")).toArrow()
        label = np.full(n, -1)
        for part, at in zip(parts["part"].to_pylist(), parts["at"]):
            label[at.values.to_numpy()] = part
        extra = np.zeros(m) if allowed is None else allowed
        order = np.lexsort((np.arange(m), -extra)).astype(np.int32)
        shared = self.spark.sparkContext.broadcast((label, extra, order))

        def touched(batches):
            for b in batches:
                users, rho = b["user_id"], b["rho"].to_numpy(zero_copy_only=False)
                lists = [_lists(b[c]) for c in ("at", "v", "seen")]
                for u in range(b.num_rows):
                    yield users[u].as_py(), rho[u], *(flat[start[u] : start[u + 1]] for flat, start in lists)

        def far(batches):
            label, extra, order = shared.value
            of, known = label[order], {}
            for user, _, at, _, seen in touched(batches):
                key = tuple(np.unique(np.r_[label[at.astype(int)], label[seen.astype(int)]]))
                if key not in known:
                    known = known if len(known) < 1000 else {}
                    near, spot = np.isin(of, key), []
                    known[key] = order[np.flatnonzero(~near)[:k]]
                    score = extra[known[key]]
                    known[key] = known[key], np.round(score, digits) + 0.0 if digits is not None else score
                spot, score = known[key]
                if len(spot):
                    yield pa.RecordBatch.from_arrays([pa.array([user] * len(spot)), pa.array(spot), pa.array(score)], ["user_id", "k", "score"])

        def near(batches):
            label = shared.value[0]
            rows = []
            fields = pa.schema([("part", pa.int32()), ("user_id", pa.string()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64())), ("seen", pa.list_(pa.int32())), ("rho", pa.float64())])
            for user, rho, at, v, seen in touched(batches):
                a, s = label[at.astype(int)], label[seen.astype(int)]
                for part in np.unique(np.r_[a, s]):
                    if part >= 0:
                        rows.append({"part": part, "user_id": user, "at": at[a == part], "v": v[a == part], "seen": seen[s == part], "rho": rho})
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, fields)

        def score(asked: pa.Table, weights: pa.Table) -> pa.Table:
            schema = pa.schema([("user_id", pa.string()), ("k", pa.int32()), ("score", pa.float64())])
            out = []
            if asked.num_rows and weights.num_rows:
                weights = weights.sort_by("r")
                targets, at = weights["r"].to_numpy(), weights["at"][0].values.to_numpy()
                w = weights["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(targets), -1).T

                class Block:
                    value = (0, np.ascontiguousarray(w), shared.value[1][targets])

                spots = lambda c, of: pa.ListArray.from_arrays(pa.array(_lists(c)[1].astype(np.int32)), pa.array(np.searchsorted(of, _lists(c)[0]).astype(np.int32)))
                for b in asked.combine_chunks().to_batches(max_chunksize=4096):
                    b = pa.RecordBatch.from_arrays([b["user_id"], spots(b["at"], at), b["v"], spots(b["seen"], targets), b["rho"]], ["user_id", "at", "v", "seen", "rho"])
                    for x in _score_block(Block, len(at), k, exclude_seen, digits)([b]):
                        out.append(pa.RecordBatch.from_arrays([x["user_id"], pa.array(targets[x["k"].to_numpy()].astype(np.int32)), x["score"]], schema=schema))
            return pa.Table.from_batches(out, schema)

        packed = cut(packed)
        asked = cut(packed.mapInArrow(near, "part int, user_id string, at array<int>, v array<double>, seen array<int>, rho double"))
        many = hint(cut(asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / USERS).cast("int").alias("salts"))))
        left = asked.join(many, "part").withColumn("salt", F.pmod(F.xxhash64("user_id"), F.col("salts")).cast("int")).drop("salts")
        right = self.rows.withColumn("part", F.element_at("at", 1)).join(many, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        by = lambda df, *c: df.select("part", "salt", *c).groupBy("part", "salt")
        scored = by(left, "user_id", "at", "v", "seen", "rho").cogroup(by(right, "r", "at", "w")).applyInArrow(score, "user_id string, k int, score double")
        both = packed.mapInArrow(far, "user_id string, k int, score double").unionByName(scored)
        return rank_top(both, k, item="k").join(F.broadcast(places(self.spark, self.items, "item_id")), "k").select("user_id", "rank", "item_id", "score")

    def scores(self, interactions: DataFrame, features: DataFrame | None = None) -> DataFrame:
        """user_id, item_id, score for all items of the model and all users of the request; duplicates are summed."""
        return self._ranked(self._packed(interactions, features, None, None, 0.0), None, False, None, None).drop("rank")

    def recommend(self, interactions: DataFrame, features: DataFrame | None = None, k: int = 100, exclude_seen: bool = True, seen: DataFrame | None = None, rho: float | DataFrame = 0.0, mask: DataFrame | None = None, users: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        """user_id, rank, item_id, score: the k best items of each user of the request, equal scores by item order.

        All items of the model are candidates, those without any weight with score 0. Items of the interactions and of
        `seen` (user_id, item_id) are left out, or with exclude_seen=False lose rho: one number or a table (user_id,
        rho), a missing user losing nothing. mask (item_id, mask) adds (mask - 1) * 1e9, a missing item counting as 0.
        `users` names users that have no other row. Unknown items and features are ignored, repeated rows are summed,
        null and NaN values count as 0, and null users are left out. digits rounds scores before they are ranked, so
        that ranks do not depend on the order of a sum.
        """
        return self._ranked(self._packed(interactions, features, seen, users, rho), k, exclude_seen, mask, digits)

    def recommend_raw(self, interactions: DataFrame, raw: DataFrame, k: int = 100, **options) -> DataFrame:
        """recommend() for raw columns (user_id and any others): by the model's transform, else columns are features.

        Without a transform numbers and texts that read as numbers become features named like their column; other
        values are ignored.
        """
        if self.transform is not None:
            return self.recommend(interactions, self.transform.apply(raw, "user_id"), k, users=raw.select("user_id"), **options)
        cells = [F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("string").try_cast("double").alias("value")) for c in raw.columns if c != "user_id"]
        if not cells:
            return self.recommend(interactions, None, k, users=raw.select("user_id"), **options)
        rows = raw.select("user_id", F.explode(F.array(*cells)).alias("f")).select("user_id", "f.feature_name", "f.value").dropna()
        return self.recommend(interactions, rows, k, users=raw.select("user_id"), **options)

    def neighbours(self, k: int = 20, items: list[str] | None = None, digits: int | None = None) -> DataFrame:
        """item, rank, item_id, score: the items to which each item gives the largest weights, itself left out."""
        m, n, wanted = len(self.items), len(self.items) + len(self.features), None if items is None else {*items}
        cols = np.array([c for c, x in enumerate(self.items) if wanted is None or x in wanted], int)
        near = 0.0 if digits is None else 10.0**-digits

        def best(batches):
            """Of each slice of rows what can be among the k best of a column once scores are rounded; of exact zeros the first k."""
            for r, a, at in _runs(batches):
                order = np.argsort(r)
                mine = np.intersect1d(cols, at[at < m]) if len(at) < n else cols
                r, s = r[order], np.ascontiguousarray(a[order][:, np.searchsorted(at, mine)].T)
                if len(at) < n and at[0] in r:  # once a component: the first items of all others, with weight 0
                    far = np.setdiff1d(np.arange(min(m, k + len(at))), at)[:k].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, len(far)).astype(np.int32)), pa.array(np.tile(far, len(mine))), pa.array(np.zeros(len(mine) * len(far)))], ["c", "r", "w"])
                s[mine[:, None] == r] = -np.inf
                zero = s == 0
                s[zero & (np.cumsum(zero, 1) > k)] = -np.inf
                if k < 1 or not s.size:
                    continue
                least = np.partition(s, max(s.shape[1] - k, 0), 1)[:, max(s.shape[1] - k, 0)]
                c, j = np.nonzero(((s >= least[:, None] - near) | np.isnan(s)) & (s != -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(mine[c].astype(np.int32)), pa.array(r[j].astype(np.int32)), pa.array(s[c, j])], ["c", "r", "w"])

        names = places(self.spark, self.items, "item").withColumnRenamed("k", "c")
        rows = self._whole_rows().mapInArrow(best, "c int, r int, w double").join(F.broadcast(names), "c")
        score = F.col("w") if digits is None else F.round("w", digits)
        top = rank_top(rows.select("item", "r", score.alias("score")), k, by="item", item="r")
        return top.join(F.broadcast(places(self.spark, self.items, "item_id").withColumnRenamed("k", "r")), "r").select("item", "rank", "item_id", "score")

    def similar(self, item: str, k: int = 20) -> DataFrame:
        """rank, item_id, score by the weights that the item gives to others; an unknown item gives no row."""
        return self.neighbours(k, [item]).drop("item")

    def validate(self) -> dict:
        """Self-check: all rows of the right length, no weight of an item on itself, no NaN or infinity, not all zero."""
        w = F.col("w")
        bad = F.isnan(w) | (F.abs(w) == float("inf"))
        cells, n = self._long(), len(self.items) + len(self.features)
        row = cells.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(bad, 1)).alias("bad"), F.max(F.when(F.col("c") == F.col("r"), F.abs(w))).alias("diagonal"), F.max(F.when(~bad, F.abs(w))).alias("largest")).first()
        if self.parted:
            whole = self.rows.agg(F.countDistinct("r")).first()[0] == len(self.items) and not self.rows.filter((F.size("w") != F.size("at")) | ~F.array_contains("at", F.col("r"))).count()
        else:
            whole = row["cells"] == len(self.items) * n and not self.rows.filter(F.size("w") != n).count()
        ok = whole and row["bad"] == 0 and (row["diagonal"] or 0) <= 1e-6 and (row["largest"] or 0) > 1e-12
        return {"passed": bool(ok), "bad": row["bad"], "diagonal": row["diagonal"] or 0.0, "largest": row["largest"] or 0.0, "whole": bool(whole)}


class BorderedModel(LinearModel):
    """A linear model whose components features connect. rows hold (r, at, w) for the items of r's own component and all
    features; the weight of any other item c is border["lift"][r] times border["drop"][c]. Rows are made when first read,
    as users without interactions meet the weights of features only, which border["features"] has as well.
    """

    def __init__(self, make, spark, border: dict[str, np.ndarray], items: list[str], features: list[str], beta: float = 1.0, transform: Transform | None = None):
        self._make, self._spark, self.border = make, spark, border
        self.items, self.features, self.beta, self.transform = items, features, beta, transform

    @cached_property
    def rows(self) -> DataFrame:
        return self._make()

    @property
    def spark(self):
        return self._spark

    @property
    def parted(self) -> bool:
        return True

    def _long(self) -> DataFrame:
        return self.dense_rows().select("r", F.posexplode("w").alias("c", "w"))

    def _whole_rows(self) -> DataFrame:
        return self.dense_rows()

    def _filled(self):
        """A function from batches of rows to (places, whole rows), BLOCK_BYTES at a time."""
        m, n = len(self.items), len(self.items) + len(self.features)
        step = max(1, min(SLICE, BLOCK_BYTES // (8 * max(n, 1))))
        shared = self.spark.sparkContext.broadcast((self.border["lift"], self.border["drop"]))

        def run(batches):
            lift, drop = shared.value
            for r, a, at in _runs(batches):
                for lo in range(0, len(r), step):
                    few = r[lo : lo + step]
                    w = np.zeros((len(few), n))
                    w[:, :m] = lift[few] @ drop.T
                    w[:, at] = a[lo : lo + step]
                    yield few, w

        return run

    def dense_rows(self) -> DataFrame:
        filled = self._filled()
        return self.rows.mapInArrow(lambda batches: (row_batch(r, w) for r, w in filled(batches)), "r int, w array<double>")

    def validate(self) -> dict:
        filled = self._filled()

        def check(batches):
            for r, w in filled(batches):
                own, fine = np.abs(w[np.arange(len(r)), r]), np.isfinite(w)
                w = np.where(fine, np.abs(w), 0.0).max(1)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array((~fine).sum(1)), pa.array(own), pa.array(w)], ["r", "bad", "diagonal", "largest"])

        found = self.rows.mapInArrow(check, "r int, bad bigint, diagonal double, largest double")
        row = found.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("r").alias("r"), F.sum("bad").alias("bad"), F.max("diagonal").alias("diagonal"), F.max("largest").alias("largest")).first()
        odd = self.rows.filter((F.size("w") != F.size("at")) | ~F.array_contains("at", F.col("r"))).count()
        whole = row["rows"] == row["r"] == len(self.items) and not odd
        ok = whole and row["bad"] == 0 and (row["diagonal"] or 0) <= 1e-6 and (row["largest"] or 0) > 1e-12
        return {"passed": bool(ok), "bad": row["bad"] or 0, "diagonal": row["diagonal"] or 0.0, "largest": row["largest"] or 0.0, "whole": bool(whole)}

    def _ranked_parts(self, packed: DataFrame, k: int | None, exclude_seen: bool, allowed: np.ndarray | None, digits: int | None) -> DataFrame:
        m, k = len(self.items), len(self.items) if k is None else k
        extra = np.zeros(m) if allowed is None else allowed
        packed = packed if hasattr(packed, "_veldt_path") else cut(packed)
        known = (F.size("seen") > 0) | F.exists("at", lambda x: x < m)
        top = self._ranked_new(packed.filter(~known), k, extra, digits)
        if not (old := packed.filter(known)).isEmpty():
            top = top.unionByName(self._ranked_old(old, k, exclude_seen, extra, digits))
        return top.join(F.broadcast(places(self.spark, self.items, "item_id")), "k").select("user_id", "rank", "item_id", "score")

    def _ranked_new(self, packed: DataFrame, k: int, extra: np.ndarray, digits: int | None) -> DataFrame:
        """Users by features alone; users with the same features are scored once."""
        m, p = len(self.items), len(self.features)
        users = packed.select("user_id", F.array_sort(F.arrays_zip("at", "v")).alias("z"))
        kinds = cut(users.groupBy("z").agg(F.min("user_id").alias("like")))
        width = max(1, min(m, BLOCK_BYTES // (8 * 512 * 2)))
        shared = self.spark.sparkContext.broadcast((self.border["features"], extra))

        def score(batches):
            features, extra = shared.value
            for b in batches:
                for lo in range(0, m, width):

                    class Block:
                        value = (lo, np.ascontiguousarray(features[lo : lo + width].T), extra[lo : lo + width])

                    yield from _score_block(Block, p, k, False, digits)([b])

        asked = kinds.select(F.col("like").alias("user_id"), F.transform("z", lambda x: x["at"] - m).alias("at"), F.col("z.v").alias("v"), F.array().cast("array<int>").alias("seen"), F.lit(0.0).alias("rho"))
        scored = spread(asked).mapInArrow(score, "user_id string, rank int, k int, score double")
        best = cut(rank_top(scored.drop("rank"), k, item="k").withColumnRenamed("user_id", "like"))
        return users.join(hint(kinds), "z").select("user_id", "like").join(hint(best), "like").select("user_id", "rank", "k", "score")

    def _ranked_old(self, packed: DataFrame, k: int, exclude_seen: bool, extra: np.ndarray, digits: int | None) -> DataFrame:
        """Users with items, against one block of targets at a time: what they used of its component and all features meet
        their weights, the sum of `drop` over what they used elsewhere meets `lift`."""
        m, p, label, lift, drop = len(self.items), len(self.features), self.border["label"], self.border["lift"], self.border["drop"]
        d = drop.shape[1]
        common = self.spark.sparkContext.broadcast((np.r_[label, np.full(p, -1)], drop, extra))

        def scorer(shared):
            def run(batches):
                label, drop, extra = common.value
                for b in (x for batch in batches for x in pa.Table.from_batches([batch]).to_batches(max_chunksize=1024)):
                    n = b.num_rows
                    (at, start), (v, _), (seen, seen_start) = (_lists(b[c]) for c in ("at", "v", "seen"))
                    row, seen_row = (np.repeat(np.arange(n), np.diff(x)) for x in (start, seen_start))
                    item = at < m
                    total = np.zeros((n, d))
                    np.add.at(total, row[item], v[item, None] * drop[at[item]])
                    for part, targets, own, w in shared.value:
                        mine = label[at] == part
                        rest = total.copy()
                        np.subtract.at(rest, row[mine], v[mine, None] * drop[at[mine]])
                        keep = mine | ~item
                        rows = np.r_[row[keep], np.repeat(np.arange(n), d)]
                        order = np.argsort(rows, kind="stable")
                        spots = np.r_[np.searchsorted(own, at[keep]), np.tile(len(own) + np.arange(d), n)][order]
                        values = np.r_[v[keep], rest.ravel()][order]
                        spot = np.minimum(np.searchsorted(targets, seen), len(targets) - 1)
                        here = targets[spot] == seen
                        lists = lambda rows, x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)), pa.array(x))
                        x = pa.RecordBatch.from_arrays([b["user_id"], lists(rows, spots.astype(np.int32)), lists(rows, values), lists(seen_row[here], spot[here].astype(np.int32)), b["rho"]], ["user_id", "at", "v", "seen", "rho"])

                        class Block:
                            value = (0, w, extra[targets])

                        for y in _score_block(Block, len(w), k, exclude_seen, digits)([x]):
                            yield pa.RecordBatch.from_arrays([y["user_id"], y["rank"], pa.array(targets[y["k"].to_numpy()].astype(np.int32)), y["score"]], ["user_id", "rank", "k", "score"])

            return run

        order = np.argsort(label, kind="stable")
        size = np.cumsum(8 * (np.bincount(label, minlength=m)[label[order]] + p + d))
        ends = np.flatnonzero(np.diff(size // BLOCK_BYTES)).tolist() + [m - 1]
        key, out, first = F.struct(F.element_at("at", 1), F.col("r")), None, 0
        for last in ends:
            lo, hi = (F.struct(F.lit(int(label[r])), F.lit(int(r))) for r in (order[first], order[last]))
            t = self.rows.filter((key >= lo) & (key <= hi)).toArrow().combine_chunks()
            blocks = []
            for part in np.unique(label[order[first : last + 1]]):
                spots = np.flatnonzero(label[t["r"].to_numpy()] == part)
                x = t.take(pa.array(spots[np.argsort(t["r"].to_numpy()[spots])]))
                targets, own = x["r"].to_numpy(), x["at"][0].values.to_numpy()
                w = x["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(targets), -1)
                blocks.append((part, targets, own, np.ascontiguousarray(np.hstack([w, lift[targets]]).T)))
            part = packed.mapInArrow(scorer(self.spark.sparkContext.broadcast(blocks)), "user_id string, rank int, k int, score double")
            out, first = part if out is None else out.unionByName(part), last + 1
        return rank_top(out.drop("rank"), k, item="k")


def rank_top(scored: DataFrame, k: int, score: str = "score", by: str = "user_id", item: str = "item_id") -> DataFrame:
    """by, rank, item, score: the k best of each group, equal scores by item; limits before its shuffle."""
    order = W.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(by, "rank", item, score)


def solve(b: Blocks, alpha: float = 1.0, beta: float = 1.0, lam: float = 100.0, meta_weight: float = 0.0, threshold: float = 0.0) -> LinearModel:
    """The dense solve in one worker task; of many items, by components that no pair connects. A singular matrix raises.

    Where features connect the components, they are solved without them and a border is added (_bordered), which takes
    a positive lambda and no threshold.
    """
    m, n = len(b.items), len(b.items) + len(b.features)
    if b.tags == 0 and not b.features:
        if 2 * np.bincount(_checked(b.label)).max() <= n:
            return LinearModel(_solved_packed(b, lam, threshold), b.items, b.features, beta)
    elif b.tags is not None and lam > 0 and threshold <= 0:
        return _bordered(b, _checked(b.label), alpha, beta, lam, meta_weight)
    b = _unpacked(b) if b.tags is not None else b
    if 24 * n * n > WHOLE_BYTES:
        label = _checked(components(b.cells, n))
        if 2 * np.bincount(label, minlength=1).max() <= n:
            return LinearModel(_solved_parts(b, label, alpha, beta, lam, meta_weight, threshold), b.items, b.features, beta)

    def run(batches):
        s = closed_form(dense_gram((x.to_pandas() for x in batches), n, alpha, beta, meta_weight), lam, threshold)
        for a in range(0, m, 256):  # the rows of features are never a target
            part = s[a : min(a + 256, m)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), lists], ["r", "w"])

    return LinearModel(cut(b.cells.coalesce(1).mapInArrow(run, "r int, w array<double>")), b.items, b.features, beta)


def _checked(label: np.ndarray) -> np.ndarray:
    """The labels of components of which none is too large."""
    largest = int(np.bincount(label, minlength=1).max())
    if 24 * largest * largest > SOLVE_BYTES:
        raise ValueError(f"a dense solve of {largest} connected ids exceeds {SOLVE_BYTES} bytes")
    return label


def _by_parts(cells: DataFrame, label: np.ndarray, alpha: float, beta: float, meta_weight: float):
    """Cells of labelled places, sorted by component, and a function that turns their batches into (places, matrix) of each."""
    n = len(label)
    order, _, spot = _layout(label)
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast((label, order, spot))

    def each(batches):
        label, order, spot = shared.value
        heads = label[order]
        part, at, g = None, None, None
        for x in batches:
            of, x = x["part"].to_numpy(), x.to_pandas()
            edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(0, int)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if of[lo] != part:
                    if part is not None:
                        yield at, g
                    part = of[lo]
                    at = order[np.searchsorted(heads, part) : np.searchsorted(heads, part, "right")]
                    g = np.zeros((len(at), len(at)))
                c = x.iloc[lo:hi]
                _add_cells(g, c.assign(i=spot[c["i"]], j=spot[c["j"]]), alpha, beta, meta_weight)
        if part is not None:
            yield at, g

    own = spark.createDataFrame(pd.DataFrame({"i": np.arange(n, dtype=np.int32), "part": label.astype(np.int32)}), "i int, part int")
    every = own.select(F.lit("none").alias("block"), "i", F.col("i").alias("j"), F.lit(0.0).alias("g"))  # ids without any cell
    cells = cells.select("block", "i", "j", F.col("g").cast("double").alias("g")).unionByName(every).join(F.broadcast(own), "i")
    return cells.repartition("part").sortWithinPartitions("part"), each


def _part_rows(at: np.ndarray, s: np.ndarray, columns: np.ndarray) -> Iterable[pa.RecordBatch]:
    """(r, at, w) of one component, SLICE rows at a time."""
    for lo in range(0, len(s), SLICE):
        rows = row_batch(at[lo : lo + len(s[lo : lo + SLICE])], s[lo : lo + SLICE])
        ats = pa.ListArray.from_arrays(rows["w"].offsets, pa.array(np.tile(columns.astype(np.int32), rows.num_rows)))
        yield pa.RecordBatch.from_arrays([rows["r"], ats, rows["w"]], ["r", "at", "w"])


def _solved_parts(b: Blocks, label: np.ndarray, alpha: float, beta: float, lam: float, meta_weight: float, threshold: float) -> DataFrame:
    """(r, at, w): the solve of each component in turn, its cells streamed in sorted order."""
    m = len(b.items)
    cells, each = _by_parts(b.cells, label, alpha, beta, meta_weight)

    def run(batches):
        for at, g in each(batches):
            yield from _part_rows(at, closed_form(g, lam, threshold)[: int((at < m).sum())], at)

    return cut(cells.mapInArrow(run, "r int, at array<int>, w array<double>"))


def _grams(b: Blocks):
    """Packed rows, sorted by component, and a function that turns their batches into (places, xtx, xtu) of each."""
    p = len(b.features)
    shared = b.cells.sparkSession.sparkContext.broadcast((*_layout(b.label), np.bincount(b.label, minlength=len(b.items))))

    def each(batches):
        order, first, spot, size = shared.value
        part, at, g, e = None, None, None, None
        for x in batches:
            w, start = _lists(x["w"])
            for n, (of, k) in enumerate(zip(x["part"].to_pylist(), spot[x["r"].to_numpy()])):
                if of != part:
                    if part is not None:
                        yield at, g, e
                    part, at = of, order[first[of] : first[of] + size[of]]
                    g, e = np.zeros((len(at), len(at))), np.zeros((len(at), p))
                row = w[start[n] : start[n + 1]]
                e[k] += row[:p]
                g[k, k:] += row[p:]
                g[k + 1 :, k] += row[p + 1 :]
        if part is not None:
            yield at, g, e

    return b.packed.repartition("part").sortWithinPartitions("part"), each


def _solved_packed(b: Blocks, lam: float, threshold: float) -> DataFrame:
    """(r, at, w): the solve of each component of a model without features, its packed rows streamed in sorted order."""
    cells, each = _grams(b)

    def run(batches):
        for at, g, _ in each(batches):
            yield from _part_rows(at, closed_form(g, lam, threshold), at)

    return cut(cells.mapInArrow(run, "r int, at array<int>, w array<double>"))


def _bordered(b: Blocks, label: np.ndarray, alpha: float, beta: float, lam: float, meta_weight: float) -> "BorderedModel":
    """The exact solve by components of items and a border of features.

    With E the columns of users' features (beta xtu) and of items' features (t, weighted), H the inverse of xtx + lambda I by
    components, L = H E and Z = diag(beta^2 utu + lambda I, -I) - E'L, the inverse of all is H + L Z^-1 L' between items,
    -L Z^-1 between items and users' features and Z^-1 between these: the rows of items' features, whose -I turns t t' into
    a border, are left out. Between components H is zero and the rest has as many columns as there are features.
    """
    m, p, q = len(b.items), len(b.features), b.tags
    d = p + q
    t = b.cells.filter("block = 't'").toPandas() if q else None
    tagged = np.zeros((m, q))
    if q:
        tagged[t["i"], t["j"]] = t["g"] * (meta_weight if meta_weight > 0 else 1.0) ** 0.5 * abs(alpha)
    known = b.cells.sparkSession.sparkContext.broadcast(tagged)
    cells, grams = _grams(b)

    def inverted(batches):
        for at, g, e in grams(batches):
            yield at, np.linalg.inv(g + lam * np.eye(len(g))), np.hstack([beta * e, known.value[at]])

    def lifts(batches):
        for at, h, e in inverted(batches):
            a = np.hstack([np.diag(h)[:, None], e, h @ e])
            for lo in range(0, len(at), SLICE):
                yield row_batch(at[lo : lo + SLICE], a[lo : lo + SLICE])

    t = cells.mapInArrow(lifts, "r int, w array<double>").toArrow()
    a = np.empty((m, 1 + 2 * d))
    a[t["r"].to_numpy()] = t["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
    del t
    diagonal, e, up = a[:, 0], a[:, 1 : 1 + d], a[:, 1 + d :]
    z = np.diag(np.r_[np.full(p, lam), np.full(q, -1.0)])
    u = b.cells.filter("block = 'utu'").toPandas()
    _add_cells(z, u.assign(i=u["i"] - m, j=u["j"] - m), alpha, beta, meta_weight)
    z = np.linalg.inv(z - e.T @ up)
    over = lambda x: np.where(np.abs(x) > 1e-12, 1.0 / np.where(x == 0, 1, x), 0.0)
    lift = -up @ z
    scale = over(diagonal - (lift * up).sum(1))
    border = {"label": label.astype(np.int32), "lift": lift, "drop": up * scale[:, None], "features": -lift[:, :p] * over(np.diag(z)[:p])}
    shared = b.cells.sparkSession.sparkContext.broadcast((border["lift"], border["drop"], border["features"], scale))

    def own(batches):
        lift, drop, features, scale = shared.value
        for at, h, _ in inverted(batches):
            s = lift[at] @ drop[at].T - h * scale[at]
            np.fill_diagonal(s, 0.0)
            yield from _part_rows(at, np.hstack([s, features[at]]), np.r_[at, np.arange(m, m + p)])

    return BorderedModel(lambda: cut(cells.mapInArrow(own, "r int, at array<int>, w array<double>")), b.cells.sparkSession, border, b.items, b.features, beta)


def train(interactions: DataFrame, user_features: DataFrame | None = None, item_features: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0, lam: float = 100.0, meta_weight: float = 0.0, threshold: float = 0.0, event_weights: dict[str, float] | None = None, decay_rate: float = 0.0, ips_alpha: float = 0.0) -> LinearModel:
    """Weights interactions, builds the blocks and solves. Negative rates raise."""
    from veldt.functions.weighting import weigh

    if min(decay_rate, ips_alpha, threshold, meta_weight) < 0:
        raise ValueError("rates and weights must not be negative")
    return solve(blocks(weigh(interactions, event_weights, decay_rate, ips_alpha), user_features, item_features), alpha, beta, lam, meta_weight, threshold)


def penalised(scored: DataFrame, seen: DataFrame, rho: float | DataFrame) -> DataFrame:
    """score - rho for items a user has seen; rho is one number or a table (user_id, rho), missing users count 0."""
    marked = scored.join(seen.select("user_id", "item_id").distinct().withColumn("__seen", F.lit(1.0)), ["user_id", "item_id"], "left")
    marked = marked.withColumn("__rho", F.lit(float(rho))) if isinstance(rho, (int, float)) else marked.join(rho.select("user_id", F.col("rho").alias("__rho")), "user_id", "left")
    return marked.withColumn("score", F.col("score") - F.coalesce("__rho", F.lit(0.0)) * F.coalesce("__seen", F.lit(0.0))).drop("__seen", "__rho")
