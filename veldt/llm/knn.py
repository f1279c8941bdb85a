"""The k most similar vectors of every vector, by learned partitions.

From a bounded sample a neighbour graph is built and cut into balanced parts; a small classifier learns which parts hold
a vector's neighbours. Large collections have two levels: each part is cut again, from a bounded sample of its own, so a
part holds about as many vectors at any size. Every vector is indexed in its most probable part. It first meets the part
in which it lies; then it asks as many more parts as its own probabilities call for, and gets back only what is nearer
than the k it has, reranked by exact cosine. Groups of equal vectors ask once, and send only their first k + 1 ids as
candidates: no other member can be among the k nearest of anything.
"""

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.session import col, cut, spread_join

#: Vectors of each collection, and of each part of the first level, on which a partition is learned, at most; all are indexed.
SAMPLE = 8192
#: Vectors that a part should hold, and the most parts that one sample can teach.
PART, MOST_PARTS = 1024, 128
#: Probability that the parts which a vector asks must add up to, and the most of them; up to PART * MOST_PROBES vectors
#: there are no more parts than that.
COVERAGE, MOST_PROBES = 0.999, 64
#: Queries of one group, above which a part's queries are cut into blocks.
ASKING = 200_000
#: Rows of one reranking block; larger parts are cut into blocks.
BLOCK = 4096
#: Digits to which cosines are rounded before ids decide.
DIGITS = 9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by dot product of unit rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, 1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each row: the graph is halved again and again along its slowest mode, at the median, then smoothed."""
    n = len(x)
    part = np.zeros(n, np.int32)
    todo = [(np.arange(n), 0, parts)]
    place = np.full(n, -1)
    while todo:
        rows, base, p = todo.pop()
        if p == 1 or len(rows) < 2:
            part[rows] = base
            continue
        left = p // 2
        place[:] = -1
        place[rows] = np.arange(len(rows))
        to = place[graph[rows]]
        src, dst = np.nonzero(to >= 0)[0], to[to >= 0]
        centred = x[rows] - x[rows].mean(0)
        f = centred @ (centred.T @ (centred @ rng.standard_normal(x.shape[1])))
        degree = np.maximum(np.bincount(src, minlength=len(rows)) + np.bincount(dst, minlength=len(rows)), 1)
        for _ in range(30):  # power steps of the lazy random walk, without its constant mode
            g = np.bincount(src, f[dst], len(rows)) + np.bincount(dst, f[src], len(rows))
            f = f + g / degree
            f -= (f * degree).sum() / degree.sum()
            f /= np.abs(f).max() + 1e-300
        cut_ = len(rows) * left // p
        order = np.lexsort((rows, f))
        side = np.zeros(len(rows), bool)
        side[order[:cut_]] = True
        for _ in range(4):  # equal numbers of rows change sides where most of their neighbours are
            pull = np.bincount(src, np.where(side[dst], 1, -1), len(rows)) + np.bincount(dst, np.where(side[src], 1, -1), len(rows))
            go, come = np.flatnonzero(side & (pull < 0)), np.flatnonzero(~side & (pull > 0))
            m = min(len(go), len(come)) // 2
            if not m:
                break
            go, come = go[np.argsort(pull[go], kind="stable")[:m]], come[np.argsort(-pull[come], kind="stable")[:m]]
            side[go], side[come] = False, True
        todo += [(rows[side], base, left), (rows[~side], base + left, p - left)]
    return part


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 64, epochs: int = 40, batch: int = 256, rate: float = 0.01) -> tuple[np.ndarray, ...]:
    """A two-layer softmax classifier from a vector to the share of its neighbours in each part; Adam."""
    d, p = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, hidden)) * math.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * math.sqrt(1 / hidden), np.zeros(p)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for e in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            z = x[i] @ w[0] + w[1]
            h = np.maximum(z, 0)
            y = h @ w[2] + w[3]
            y = np.exp(y - y.max(1, keepdims=True))
            dy = (y / y.sum(1, keepdims=True) - target[i]) / len(i)
            dh = dy @ w[2].T * (z > 0)
            t += 1
            for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ dy, dy.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (1 - e / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def probabilities(x: np.ndarray, w: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """The share of each row's neighbours expected in each part."""
    if w is None:
        return np.ones((len(x), 1))
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def learn_parts(x: np.ndarray, rows: int, parts: int, k: int, seed: int = 7) -> tuple[np.ndarray, ...] | None:
    """The router of so many parts of a collection, learned from a sample x of it; None for one part."""
    parts = int(min(parts, MOST_PARTS, max(1, len(x) // 32)))
    if parts <= 1:
        return None
    rng = np.random.default_rng(seed)
    x = _unit(x.astype(float))
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / (graph.shape[1] + 1))
    target[np.arange(len(x)), part] += 1 / (graph.shape[1] + 1)
    return train_router(x, target, rng)


def home(x: np.ndarray, model: dict) -> np.ndarray:
    """The part in which each row is indexed: the most probable one, of the most probable one of the first level."""
    first = probabilities(x, model["w"]).argmax(1)
    out = first * MOST_PARTS
    for c, w in model["inner"].items():
        mine = np.flatnonzero(first == c)
        if len(mine):
            out[mine] += probabilities(x[mine], w).argmax(1)
    return out


def ask_parts(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): the parts that each row asks, by falling probability, until they add up to COVERAGE."""
    outer = probabilities(x, model["w"])
    rows, parts, chance = [], [], []
    order = np.argsort(-outer, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(outer, order, 1), 1)
    wanted = np.zeros(outer.shape, bool)
    np.put_along_axis(wanted, order, np.c_[np.zeros(len(x)), upto[:, :-1]] < COVERAGE, 1)
    for c in range(outer.shape[1]):
        mine = np.flatnonzero(wanted[:, c])
        if not len(mine):
            continue
        inner = probabilities(x[mine], model["inner"].get(c))
        rows.append(np.repeat(mine, inner.shape[1]))
        parts.append(np.tile(c * MOST_PARTS + np.arange(inner.shape[1]), len(mine)))
        chance.append((inner * outer[mine, c][:, None]).ravel())
    rows, parts, chance = np.concatenate(rows), np.concatenate(parts), np.concatenate(chance)
    order = np.lexsort((parts, -chance, rows))
    rows, parts, chance = rows[order], parts[order], chance[order]
    start = np.searchsorted(rows, np.arange(len(x)))
    before = np.cumsum(chance) - chance
    before -= before[start][rows]
    keep = (before < COVERAGE) & (np.arange(len(rows)) - start[rows] < MOST_PROBES)
    return rows[keep], parts[keep]


def _pack(size: int, with_id: bool):
    """Arrow batches with vec array<float> into batches with the vector as bytes; unusable vectors are dropped."""

    def run(batches):
        for b in batches:
            v = b["vec"]
            n = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, int)
            ok = v.is_valid().to_numpy(zero_copy_only=False) & (n == size)
            b = b.filter(pa.array(ok))
            v = b["vec"]
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # null entries become NaN
            x = flat.reshape(-1, size) + np.float32(0)  # no negative zeros
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x = np.ascontiguousarray(x[ok])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            b = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([b["id"], packed], ["id", "vec"])

    return run


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(float)


def _nearest_of(cand: pd.DataFrame, ask: np.ndarray, least: np.ndarray, k: int):
    """For each row of ask the k best candidates by rounded cosine, then id, of those not below its least: (ids, sims)."""
    cand = cand.sort_values("id", key=lambda s: s.map(str.encode))
    c, ids = _unit(_vectors(cand["vec"])), cand["id"].to_numpy()
    for a in range(0, len(ask), 512):
        s = np.round(_unit(ask[a : a + 512]) @ c.T, DIGITS)
        bound = least[a : a + 512]
        if s.shape[1] > k and not np.isfinite(bound).all():
            bound = np.maximum(bound, np.partition(s, s.shape[1] - k, 1)[:, -k])
        r, j = np.nonzero(s >= bound[:, None])  # candidates stand in the order of their ids
        order = np.lexsort((j, -s[r, j], r))
        r, j = r[order], j[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, j = r[nth < k], j[nth < k]
        at = np.searchsorted(r, np.arange(len(s) + 1))
        for i, (x, y) in enumerate(zip(at, at[1:])):
            yield a + i, ids[j[x:y]], s[i, j[x:y]]


def _at_home(k: int):
    """The candidates of one block, those with a query number asking the others: q, vec, ids, sims and the least of k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf[pdf["q"] >= 0]
        out = {"q": ask["q"].to_numpy(), "vec": ask["vec"].to_numpy(), "part": ask["part"].to_numpy(), "cb": ask["cb"].to_numpy()}
        found = [*_nearest_of(pdf, _vectors(ask["vec"]), np.full(len(ask), -np.inf), k)] if len(ask) else []
        return pd.DataFrame(out | {"ids": pd.Series([x[1] for x in found], dtype=object), "sims": pd.Series([x[2] for x in found], dtype=object), "least": [float(x[2][-1]) if len(x[2]) == k else -np.inf for x in found]})

    return run


def _elsewhere(k: int):
    """Candidates and queries of one block pair: for each query what is at least as near as the least it has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cand, ask = pdf[pdf["q"] < 0], pdf[pdf["q"] >= 0]
        found = [x for x in _nearest_of(cand, _vectors(ask["vec"]), ask["least"].to_numpy(), k) if len(x[1])] if len(cand) and len(ask) else []
        q = ask["q"].to_numpy()
        return pd.DataFrame({"q": np.array([q[x[0]] for x in found], np.int64), "ids": pd.Series([x[1] for x in found], dtype=object), "sims": pd.Series([x[2] for x in found], dtype=object)})

    return run


def _batched(function):
    """mapInPandas over slices of 4096 rows, given as unit vectors."""

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                part = pdf.iloc[a : a + 4096]
                yield function(part, _unit(_vectors(part["vec"])))

    return run


def fit_index(queries: DataFrame, n: int, k: int) -> dict:
    """w, inner: the router of the first level and, where one sample teaches too few parts, those of its parts.

    All fits see at most SAMPLE vectors, chosen by hash; those of the second level run as one task a part.
    """
    leaves = max(1, math.ceil(n / PART))
    first = leaves if leaves <= MOST_PARTS else min(MOST_PARTS, math.ceil(math.sqrt(leaves)))
    sample = queries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE)

    def fit(batches):
        found = [x for pdf in batches for x in pdf["vec"]]
        if found:
            yield pd.DataFrame({"model": [pickle.dumps(learn_parts(_vectors(found), n, first, k))]})

    got = sample.coalesce(1).mapInPandas(fit, "model binary").collect()  # one row of some hundred kB: the bounded model
    model = {"w": pickle.loads(bytes(got[0]["model"])) if got else None, "inner": {}}
    if leaves <= MOST_PARTS:
        return model

    def placed(pdf, x):
        return pd.DataFrame({"c": probabilities(x, model["w"]).argmax(1).astype(np.int32), "vec": pdf["vec"].to_numpy()})

    held = queries.select("vec").mapInPandas(_batched(placed), "c int, vec binary")
    below = -(2.0**63) + 2.0**64 * min(1.0, 1.5 * SAMPLE * first / n)
    chosen = held.filter(F.xxhash64("vec") <= below)
    sizes = {r["c"]: r["count"] for r in held.groupBy("c").count().collect()}  # one row a part

    def inner(key, pdf):
        x = _vectors(pdf["vec"].sort_values().iloc[: len(pdf)])
        x = x[np.random.default_rng(7).permutation(len(x))[:SAMPLE]]
        w = learn_parts(x, sizes[key[0]], math.ceil(sizes[key[0]] / PART), k)
        return pd.DataFrame({"c": [key[0]], "model": [pickle.dumps(w)]})

    models = chosen.groupBy("c").applyInPandas(inner, "c int, model binary").collect()  # at most MOST_PARTS rows of some ten kB
    return model | {"inner": {r["c"]: pickle.loads(bytes(r["model"])) for r in models}}


def _blocks(rows: DataFrame, size: int) -> Column:
    """Into how many blocks of about this size the rows of a part are cut: a column over `part`."""
    large = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n")).filter("n > 1")  # at most one row a part
    many = {r["part"]: r["n"] for r in large.collect()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("part")], F.lit(1)) if many else F.lit(1)


def nearest(df: DataFrame, id_: str, vector: str, k: int = 10, size: int = 32) -> DataFrame:
    """id, ids: the k ids most similar to each id by cosine (double precision, rounded), equal ones by ascending id.

    Null vectors, vectors of another size, with a null, NaN or infinite entry or all zero take no part, nor do null ids;
    repeated rows (same id and vector) count once; equal vectors of different ids are neighbours with cosine 1. With
    fewer than k other vectors all are given; one vector alone gets an empty list; an empty table gives no row. Other
    columns are ignored. The index is fitted on at most SAMPLE distinct vectors, and holds all.
    """
    rows = df.select(col(id_).cast("string").alias("id"), col(vector).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    rows = cut(rows.mapInArrow(_pack(size, True), "id string, vec binary").distinct())
    # The first ids of each vector; the very first one asks, under a number of its own.
    firsts = rows.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    firsts = cut(firsts.select("id", "vec", F.when(F.col("r") == 1, F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("q")))
    queries = firsts.filter("q >= 0").select("q", "vec")
    n = queries.count()
    model = fit_index(queries, n, k)

    def indexed(pdf, x):
        return pdf.assign(part=home(x, model).astype(np.int32))

    cand = cut(firsts.mapInPandas(_batched(indexed), "id string, vec binary, q bigint, part int"))
    # A part's candidates stand in blocks, so that a part of any size is spread.
    blocks = _blocks(cand, BLOCK)
    cand = cand.withColumn("cb", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    near = cut(cand.groupBy("part", "cb").applyInPandas(_at_home(k + 1), "q bigint, vec binary, part int, cb int, ids array<string>, sims array<double>, least double"))

    def asking(with_vectors: bool):
        def run(pdf, x):
            r, parts = ask_parts(x, model)
            if not with_vectors:
                return pd.DataFrame({"part": parts.astype(np.int32)})
            return pdf.iloc[r].rename(columns={"part": "own", "cb": "own_cb"}).assign(part=parts.astype(np.int32))

        return run

    asked = near.select("q", "vec", "least", "part", "cb").mapInPandas(_batched(asking(True)), "q bigint, vec binary, least double, own int, own_cb int, part int")
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), blocks - 1))).filter("part <> own or cb <> own_cb")
    # No group can have more queries than there are; if those are many, they are counted by part and cut into blocks.
    asking_blocks = _blocks(near.select("vec").mapInPandas(_batched(asking(False)), "part int"), ASKING) if n > ASKING else F.lit(1)
    right = asked.select("part", "cb", F.pmod(F.xxhash64("q"), asking_blocks).cast("int").alias("qb"), "q", F.lit(None).cast("string").alias("id"), "vec", "least")
    left = cand.select("part", "cb", F.explode(F.sequence(F.lit(0), asking_blocks - 1)).alias("qb"), F.lit(-1).cast("bigint").alias("q"), "id", "vec", F.lit(None).cast("double").alias("least"))
    further = left.unionByName(right).groupBy("part", "cb", "qb").applyInPandas(_elsewhere(k + 1), "q bigint, ids array<string>, sims array<double>")
    answers = near.select("q", "ids", "sims").unionByName(further)
    ranked = F.transform(F.arrays_zip("ids", "sims"), lambda x: F.struct((-x["sims"]).alias("s"), x["ids"].alias("id")))
    merged = answers.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(ranked))), 1, k + 1).alias("best"))
    merged = queries.join(merged, "q").select("vec", F.transform("best", lambda x: x["id"]).alias("best"))
    # A vector that very many ids share is one key; its rows are spread.
    out = spread_join(rows, merged, "vec", "id").select("id", F.slice(F.filter("best", lambda x: x != F.col("id")), 1, k).alias("ids"))
    return out


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """id_a < id_b: the distinct pairs of which one is among the nearest of the other."""
    pairs = near.select("id", F.explode("ids").alias("other")).filter("id <> other")
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
