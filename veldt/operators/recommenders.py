"""The sequence and two-tower models over DataFrames: train in one worker task, score whole tables in batches, save by ids."""

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import ann
from veldt.operators.linear import LinearModel, best_of, places, rank_top
from veldt.operators.mappings import index
from veldt.operators.neural import SequenceModel, TwoTower
from veldt.operators.sequences import feature_table, histories, padded_sequences, positive_pairs
from veldt.session import cut, hint, release
from veldt.sources.persist import read_arrays, read_meta, write_arrays, write_meta

#: Histories, and positive pairs (8 bytes each and 8 for their order), on which one worker task may train; more raise, so
#: that no task is overrun silently.
MOST_ROWS, MOST_PAIRS = 2_000_000, 50_000_000
#: Bytes of parameters that a model may have: they are sent to every worker.
MODEL_BYTES = 500_000_000
#: Rows scored at once, and items of one product.
BATCH, WIDTH = 256, 8192

RANKED = "user_id string, rank int, k int, score double"


def _train(df: DataFrame, run) -> tuple:
    """Runs a training function over all rows of a bounded table, in one worker task; it returns plain arrays."""
    n = df.limit(MOST_ROWS + 1).count()
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} training rows for one task")

    def task(batches):
        yield pd.DataFrame({"model": [pickle.dumps(run(pd.concat([*batches]) if n else pd.DataFrame()))]})

    got = df.coalesce(1).mapInPandas(task, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else run(pd.DataFrame())


def _names(mapping: DataFrame, dim: int) -> list[str]:
    """The ids of a mapping in order; more than a model can hold raise, and none is left out."""
    most = MODEL_BYTES // (8 * dim)
    rows = mapping.orderBy("idx").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ids exceed {MODEL_BYTES} bytes of parameters")
    return [r["id"] for r in rows]


def _best_blocks(product, n: int, items: int, without: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, item, place and score of the k best items of n rows, from products over blocks of WIDTH items."""
    rows, cols, scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for lo in range(0, items, WIDTH):
        s = product(lo, min(lo + WIDTH, items))
        for i, old in enumerate(without):
            here = np.asarray(old, int) - lo
            s[i, here[(here >= 0) & (here < s.shape[1])]] = -np.inf
        r, j, _ = best_of(s, k)
        rows, cols, scores = np.r_[rows, r], np.r_[cols, j + lo], np.r_[scores, s[r, j]]
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = nth < k
    return rows[keep], cols[keep], nth[keep], scores[keep]


def _seen(interactions: DataFrame, items: list[str]) -> DataFrame:
    """u, seen: the places of the known items of each user; as many as the model has items, at most."""
    rows = interactions.select(F.col("user_id").cast("string").alias("u"), F.col("item_id").cast("string").alias("item_id"))
    return rows.join(F.broadcast(places(interactions.sparkSession, items, "item_id")), "item_id").groupBy("u").agg(F.collect_set("k").alias("seen"))


def _asking(interactions: DataFrame, features: DataFrame | None, users: DataFrame | None) -> DataFrame:
    """user_id: all users of a request."""
    rows = interactions.select(F.col("user_id").cast("string").alias("user_id"))
    for more in (features, users):
        rows = rows if more is None else rows.union(more.select(F.col("user_id").cast("string")))
    return rows.filter("user_id is not null").distinct()


class _Vectors:
    """What the models with item vectors share: similar items, by cosine, for one item or as a table for all."""

    def similar(self, item: str, k: int = 20) -> list[tuple[str, float]]:
        """By cosine of item vectors; an unknown item gives none."""
        if item not in self.items:
            return []
        x = self.item_vectors()
        v = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
        i = self.items.index(item)
        return _ranked(v @ v[i], self.items, {i}, k)

    def vector_frame(self, spark) -> DataFrame:
        """id, v: the item vectors by place."""
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(self.items)), "v": self.item_vectors().tolist()}), "id bigint, v array<double>")

    def neighbours(self, spark, k: int = 20) -> DataFrame:
        """item, rank, item_id, score: the k nearest of every item."""
        v = self.vector_frame(spark)
        top = ann.top_k(v, v, k, cosine=True, exclude_self=True)
        a, b = (F.broadcast(places(spark, self.items, n).withColumnRenamed("k", c)) for n, c in (("item", "query_id"), ("near", "near_id")))
        return top.withColumnRenamed("item_id", "near_id").join(a, "query_id").join(b, "near_id").select("item", "rank", F.col("near").alias("item_id"), "score")


@dataclass
class SequenceRecommender(_Vectors):
    model: SequenceModel
    items: list[str]
    losses: list[float]

    @staticmethod
    def train(interactions: DataFrame, dim: int = 64, length: int = 50, heads: int = 2, layers: int = 2, dropout: float = 0.2, epochs: int = 50, batch: int = 16, rate: float = 1e-3, patience: int = 5, seed: int = 42) -> "SequenceRecommender":
        if "days_ago" not in interactions.columns:
            raise ValueError("days_ago is needed to order histories")
        if dim % heads or not 0 <= dropout < 1:
            raise ValueError("dim must be a multiple of heads, and dropout at least 0 and below 1")
        mapping = index((interactions, "item_id"))
        items = _names(mapping, dim)
        rows = padded_sequences(interactions, mapping, length).orderBy("user_id")

        def run(pdf):
            model = SequenceModel(len(items) + 1, dim, length, heads, layers, seed)
            losses = model.fit(np.array(pdf["input"].tolist()), np.array(pdf["target"].tolist()), epochs, batch, rate, patience, seed, dropout) if len(pdf) else []
            return model.arrays(), losses

        arrays, losses = _train(rows, run)
        return SequenceRecommender(SequenceModel.of(arrays), items, losses)

    def item_vectors(self) -> np.ndarray:
        return self.model.p["e"].data[1:]

    def predict(self, history: list[str], top_k: int = 100) -> list[tuple[str, float]]:
        """The best items that are not in the history (oldest first); unknown ids are skipped."""
        at = {x: k + 1 for k, x in enumerate(self.items)}
        tokens = [at[x] for x in history if x in at]
        return _ranked(self.model.score(tokens)[1:], self.items, {t - 1 for t in tokens}, top_k)

    def recommend(self, interactions: DataFrame, features: DataFrame | None = None, k: int = 100, users: DataFrame | None = None, exclude_seen: bool = True) -> DataFrame:
        """user_id, rank, item_id, score for all users of the request; features are not used.

        A user without known items gets the scores without context. Histories are ordered by days_ago, scored in
        batches in the tasks, and only the k best leave them.
        """
        spark, n = interactions.sparkSession, len(self.items)
        mapping = places(spark, self.items, "id").withColumnRenamed("k", "idx")
        hist = histories(interactions, hint(mapping), self.model.config[2]).select(F.col("user_id").cast("string").alias("u"), "h")
        rows = _asking(interactions, None, users).join(hist, F.col("user_id") == F.col("u"), "left").drop("u")
        rows = rows.join(_seen(interactions, self.items), F.col("user_id") == F.col("u"), "left").select("user_id", "h", "seen")
        shared = spark.sparkContext.broadcast(self.model.arrays())

        def run(batches):
            model = SequenceModel.of(shared.value)
            for pdf in batches:
                for a in range(0, len(pdf), BATCH):
                    part = pdf.iloc[a : a + BATCH]
                    s = model.score_all([[] if h is None else list(h) for h in part["h"]])[:, 1:]
                    old = [[] if x is None or not exclude_seen else x for x in part["seen"]]
                    r, j, nth, score = _best_blocks(lambda lo, hi: s[:, lo:hi].copy(), len(part), n, old, k)
                    yield pd.DataFrame({"user_id": part["user_id"].to_numpy()[r], "rank": (nth + 1).astype(np.int32), "k": j.astype(np.int32), "score": score})

        return _named(rows.mapInPandas(run, RANKED), self.items)

    def validate(self) -> bool:
        return bool(self.items) and len(self.items) + 1 == self.model.config[0] and all(np.isfinite(t.data).all() for t in self.model.p.values())

    def save(self, path: str) -> None:
        _save(path, self, {"family": "sequence", "items": self.items})

    @staticmethod
    def load(path: str) -> "SequenceRecommender":
        meta, arrays = _load(path, "sequence")
        out = SequenceRecommender(SequenceModel.of(arrays), meta["items"], [])
        if not out.validate():
            raise ValueError("the parameters do not fit the items")
        return out


@dataclass
class TwoTowerRecommender(_Vectors):
    model: TwoTower
    users: list[str]
    items: list[str]
    slots: dict[str, tuple[bool, int]]
    vectors: np.ndarray
    losses: list[float]
    #: How recommend() finds items: None scores all of them; "exact", "hyperplanes" and "codes" ask a vector index.
    index: str | None = field(default=None)

    @staticmethod
    def train(interactions: DataFrame, user_features: DataFrame | None = None, item_features: DataFrame | None = None, dim: int = 32, temperature: float = 0.05, epochs: int = 50, batch: int = 256, rate: float = 0.01, id_dropout: float = 0.1, seed: int = 0) -> "TwoTowerRecommender":
        """Trains on the positive pairs, each with the features of its user and item, joined in Spark."""
        pairs, users, items = positive_pairs(interactions)
        users, items = cut(users), cut(items)
        names = [_names(m, dim) for m in (users, items)]
        empty = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("cat", "int"), ("dense", "double"))]
        rows, known = pairs.select(F.lit("p").alias("kind"), F.col("user_idx").cast("int").alias("a"), F.col("item_idx").cast("int").alias("b"), *empty), []
        for side, features, key, mapping in (("u", user_features, "user_id", users), ("i", item_features, "item_id", items)):
            slots = {}
            if features is not None:
                table, kinds = feature_table(features, key, mapping)
                most = MODEL_BYTES // (8 * dim)
                slots = {r["feature_name"]: (r["categorical"], r["slot"]) for r in kinds.limit(most + 1).collect()}
                if len(slots) > most:
                    raise ValueError(f"more than {most} features")
                rows = rows.union(table.select(F.lit(side), F.col("entity_idx").cast("int"), F.lit(0), F.col("cat").cast("array<int>"), F.col("dense").cast("array<double>")))
            known.append(slots)
        counts = [sum(c == want for c, _ in slots.values()) for slots in known for want in (True, False)]
        sizes = (len(names[0]) + 1, len(names[1]), *counts)

        rows = cut(rows)
        if (n := rows.filter("kind = 'p'").count()) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} training rows for one task")

        def run(batches):
            """Pairs and features stream in a batch at a time; only numbers are kept."""
            model, pairs, filled = TwoTower(*sizes, dim, temperature, seed), np.zeros(n, np.int64), 0
            sides = {s: (np.zeros((k, cats), np.uint8), np.zeros((k, numbers))) for s, k, cats, numbers in (("u", sizes[0], *sizes[2:4]), ("i", sizes[1], *sizes[4:6]))}
            for b in batches:
                kind, a = b["kind"].to_numpy(zero_copy_only=False), b["a"].to_numpy()
                here = kind == "p"
                got = int(here.sum())
                pairs[filled : filled + got] = (a[here].astype(np.int64) << 32) + b["b"].to_numpy()[here]
                filled += got
                for side, (cat, dense) in sides.items():
                    if (part := pa.RecordBatch.filter(b, pa.array(kind == side))).num_rows:
                        for at, c, d in zip(part["a"].to_pylist(), part["cat"].to_pylist(), part["dense"].to_pylist()):
                            cat[at, c], dense[at] = 1, d
            pairs.sort()  # the order of rows does not count
            pairs = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1, dtype=np.int32, casting="unsafe")
            losses = model.fit(pairs, sides["u"], sides["i"], epochs, batch, rate, id_dropout, seed) if n else []
            vectors = model.vectors("i", np.arange(sizes[1]), *sides["i"]) if n else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.arrays(), vectors, losses))], pa.binary())], ["model"])

        got = rows.coalesce(1).mapInArrow(run, "model binary").collect() if n else []
        release(rows, users, items)
        if got:
            arrays, vectors, losses = pickle.loads(bytes(got[0]["model"]))
        else:
            arrays, vectors, losses = TwoTower(*sizes, dim, temperature, seed).arrays(), np.zeros((0, dim)), []
        return TwoTowerRecommender(TwoTower.of(arrays), *names, known[0], vectors, losses)

    def item_vectors(self) -> np.ndarray:
        return self.vectors

    def user_vector(self, user: str | None, features: dict[str, float] | None = None) -> np.ndarray:
        """An unknown user is the cold-start row; unknown features and zero categories are skipped."""
        at = self.users.index(user) + 1 if user in self.users else 0
        cats, dense = np.zeros((1, self.model.sizes[2])), np.zeros((1, self.model.sizes[3]))
        for name, value in (features or {}).items():
            if name in self.slots:
                categorical, slot = self.slots[name]
                if categorical and value != 0:
                    cats[0, slot] = 1
                elif not categorical:
                    dense[0, slot] = value
        return self.model.vectors("u", np.array([at]), cats, dense)[0]

    def predict(self, user: str | None, features: dict[str, float] | None = None, top_k: int = 100) -> list[tuple[str, float]]:
        """By plain dot product; nothing is excluded."""
        return _ranked(self.vectors @ self.user_vector(user, features), self.items, set(), top_k)

    def request(self, interactions: DataFrame, features: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
        """user_id, idx, cat, dense, seen: features routed to category slots (values but 0) and numbers (the largest of repeats)."""
        spark = interactions.sparkSession
        ids = places(spark, self.users, "user_id", 1).withColumnRenamed("k", "idx")
        rows = _asking(interactions, features, users).join(hint(ids), "user_id", "left").withColumn("idx", F.coalesce("idx", F.lit(0)))
        if features is not None and self.slots:
            slots = spark.createDataFrame([(n, c, s) for n, (c, s) in self.slots.items()], "feature_name string, categorical boolean, slot int")
            cells = features.select(F.col("user_id").cast("string").alias("u"), "feature_name", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).join(F.broadcast(slots), "feature_name")
            cells = cells.groupBy("u", "categorical", "slot").agg(F.max("value").alias("value"), F.max(F.col("value") != 0).alias("any"))
            cells = cells.groupBy("u").agg(F.collect_list(F.when(F.col("categorical") & F.col("any"), F.col("slot"))).alias("cat"), F.collect_list(F.when(~F.col("categorical"), F.struct("slot", "value"))).alias("dense"))
            rows = rows.join(cells, F.col("user_id") == F.col("u"), "left").drop("u")
        else:
            rows = rows.withColumn("cat", F.lit(None).cast("array<int>")).withColumn("dense", F.lit(None).cast("array<struct<slot int, value double>>"))
        return rows.join(_seen(interactions, self.items), F.col("user_id") == F.col("u"), "left").drop("u")

    def _towers(self, shared):
        """Batches of request() into (rows, user vectors)."""

        def run(batches):
            model = TwoTower.of(shared.value[0])
            for pdf in batches:
                for a in range(0, len(pdf), BATCH):
                    part = pdf.iloc[a : a + BATCH]
                    cats, dense = np.zeros((len(part), model.sizes[2])), np.zeros((len(part), model.sizes[3]))
                    for i, (c, d) in enumerate(zip(part["cat"], part["dense"])):
                        if c is not None:
                            cats[i, np.asarray(c, int)] = 1
                        for x in () if d is None else d:
                            dense[i, x["slot"]] = x["value"]
                    yield part, model.vectors("u", part["idx"].to_numpy(np.int64), cats, dense)

        return run

    def recommend(self, interactions: DataFrame, features: DataFrame | None = None, k: int = 100, users: DataFrame | None = None, exclude_seen: bool = True, exact: bool = False) -> DataFrame:
        """user_id, rank, item_id, score for all users of the request, by plain dot product; unknown users are the cold-start row.

        With an index (see enable_index) its candidates are ranked, as many more as the user with most seen items needs;
        exact=True scores all items all the same.
        """
        spark = interactions.sparkSession
        rows = self.request(interactions, features, users)
        shared = spark.sparkContext.broadcast((self.model.arrays(), self.vectors))
        towers, items = self._towers(shared), len(self.items)
        if self.index is None or exact:

            def run(batches):
                v = shared.value[1]
                for part, u in towers(batches):
                    old = [[] if x is None or not exclude_seen else x for x in part["seen"]]
                    r, j, nth, score = _best_blocks(lambda lo, hi: u @ v[lo:hi].T, len(part), items, old, k)
                    yield pd.DataFrame({"user_id": part["user_id"].to_numpy()[r], "rank": (nth + 1).astype(np.int32), "k": j.astype(np.int32), "score": score})

            return _named(rows.mapInPandas(run, RANKED), self.items)

        def vectors(batches):
            for part, u in towers(batches):
                yield part[["user_id", "q", "seen"]].assign(v=list(u))

        asked = cut(rows.withColumn("q", F.monotonically_increasing_id()).mapInPandas(vectors, "user_id string, q bigint, seen array<int>, v array<double>"))
        most = asked.agg(F.max(F.size(F.coalesce("seen", F.array().cast("array<int>"))))).first()[0] or 0
        want = min(items, k + (most if exclude_seen else 0))
        queries, base = asked.select(F.col("q").alias("id"), "v"), self.vector_frame(spark)
        if self.index == "hyperplanes":
            found = ann.hyperplane_top_k(queries, base, want, self.model.dim)
        else:
            found = ann.top_k(queries, base, want, codes=self.index == "codes")
        found = found.select(F.col("query_id").alias("q"), F.col("item_id").cast("int").alias("k"), "score").join(asked.drop("v"), "q")
        if exclude_seen:
            found = found.filter(~F.coalesce(F.array_contains("seen", F.col("k")), F.lit(False)))
        return _named(rank_top(found, k, item="k"), self.items)

    def enable_index(self, kind: str | None) -> "TwoTowerRecommender":
        """Attaches "exact", "hyperplanes" or "codes" as the way to find items; None detaches it."""
        if kind not in (None, "exact", "hyperplanes", "codes"):
            raise ValueError(f"unknown index {kind}")
        self.index = kind
        return self

    def validate(self) -> bool:
        return bool(self.items) and len(self.vectors) == len(self.items) and bool(np.isfinite(self.vectors).all())

    def payload(self) -> dict:
        """What an outside scorer needs: ids, feature slots, and all arrays as little-endian doubles with their shapes."""
        if not self.validate():
            raise ValueError("the model fails its self-check")
        arrays = self.model.arrays() | {"vectors": self.vectors}
        return {"users": self.users, "items": self.items, "slots": self.slots, "arrays": {k: (list(a.shape), a.astype("<f8").tobytes()) for k, a in arrays.items()}}

    @staticmethod
    def of_payload(data: dict) -> "TwoTowerRecommender":
        """The scorer that a payload describes."""
        arrays = {k: np.frombuffer(b, "<f8").reshape(shape) for k, (shape, b) in data["arrays"].items()}
        return TwoTowerRecommender(TwoTower.of(arrays), data["users"], data["items"], {k: tuple(v) for k, v in data["slots"].items()}, arrays["vectors"], [])

    def save(self, path: str) -> None:
        _save(path, self, {"family": "two-tower", "users": self.users, "items": self.items, "slots": self.slots}, {"vectors": self.vectors})

    @staticmethod
    def load(path: str) -> "TwoTowerRecommender":
        meta, arrays = _load(path, "two-tower")
        out = TwoTowerRecommender(TwoTower.of(arrays), meta["users"], meta["items"], {k: tuple(v) for k, v in meta["slots"].items()}, arrays["vectors"], [])
        if not out.validate() or out.model.sizes[:2] != (len(out.users) + 1, len(out.items)):
            raise ValueError("the parameters do not fit the ids")
        return out


#: Version of the saved neural models; others are refused.
NEURAL_VERSION = 2


def _save(path: str, model, meta: dict, more: dict[str, np.ndarray] | None = None) -> None:
    if not model.validate():
        raise ValueError("the model fails its self-check")
    spark = SparkSession.active()
    write_arrays(spark, path, model.model.arrays() | (more or {}))
    write_meta(spark, path, meta | {"version": NEURAL_VERSION})


def _load(path: str, family: str) -> tuple[dict, dict[str, np.ndarray]]:
    spark = SparkSession.active()
    meta = read_meta(spark, path)
    if meta.get("family") != family or meta.get("version") != NEURAL_VERSION:
        raise ValueError(f"not a {family} model of version {NEURAL_VERSION}: {meta.get('family')} {meta.get('version')}")
    return meta, read_arrays(spark, path)


def _named(ranked: DataFrame, items: list[str]) -> DataFrame:
    return ranked.join(F.broadcast(places(ranked.sparkSession, items, "item_id")), "k").select("user_id", "rank", "item_id", "score")


def _ranked(scores: np.ndarray, items: list[str], without: set[int], k: int) -> list[tuple[str, float]]:
    order = [i for i in np.argsort(-scores, kind="stable") if i not in without][:k]
    return [(items[i], float(scores[i])) for i in order]


class Registry:
    """Models of any family by territory, with one fallback territory."""

    FAMILIES = {LinearModel: "linear", SequenceRecommender: "sequence", TwoTowerRecommender: "two_tower"}

    def __init__(self, fallback: str | None = None):
        self.models: dict[str, object] = {}
        self.fallback = fallback

    def register(self, territory: str, model) -> None:
        self.models[territory] = model

    def unregister(self, territory: str) -> bool:
        return self.models.pop(territory, None) is not None

    def territories(self) -> list[str]:
        return sorted(self.models)

    def __len__(self) -> int:
        return len(self.models)

    def __bool__(self) -> bool:
        return bool(self.models)

    def route(self, territory: str):
        for key in (territory, self.fallback):
            if key in self.models:
                return self.models[key]
        raise KeyError(f"no model for {territory!r} and no fallback")

    def family(self, territory: str) -> str:
        model = self.route(territory)
        return self.FAMILIES.get(type(model), type(model).__name__)

    def _of(self, territory: str, family: str):
        if (found := self.family(territory)) != family:
            raise TypeError(f"{territory!r} has a {found} model: use predict_{found}()")
        return self.route(territory)

    def predict_linear(self, territory: str, requests: DataFrame, features: DataFrame | None = None, k: int = 100) -> DataFrame:
        """recommend() of the territory's linear model."""
        return self._of(territory, "linear").recommend(requests, features, k)

    def predict_sequence(self, territory: str, history: list[str], k: int = 100) -> list[tuple[str, float]]:
        return self._of(territory, "sequence").predict(history, k)

    def predict_two_tower(self, territory: str, user: str | None, features: dict[str, float] | None = None, k: int = 100) -> list[tuple[str, float]]:
        return self._of(territory, "two_tower").predict(user, features, k)

    def predict(self, territory: str, *args, **kwargs):
        """The answer of the territory's model, in the form that its family takes."""
        model = self.route(territory)
        if not hasattr(model, "predict"):
            raise TypeError(f"{territory!r} has a {self.family(territory)} model that answers tables: use predict_linear() or recommend()")
        return model.predict(*args, **kwargs)

    def similar(self, territory: str, item: str, k: int = 20):
        return self.route(territory).similar(item, k)

    def recommend(self, requests: DataFrame, interactions: DataFrame, features: DataFrame | None = None, k: int = 100) -> DataFrame:
        """user_id, territory, rank, item_id, score for requests (user_id, territory); one plan per model, not per user.

        Requests of any territory without a model, null included, go to the fallback.
        """
        known = list(self.models)
        own = F.coalesce(F.col("territory").isin(known), F.lit(False))
        # No more rows than models.
        wanted = {r[0]: F.col("territory") == r[0] for r in requests.filter(own).select("territory").distinct().collect()}
        for r in requests.filter(~own).select("territory").limit(1).collect():
            if self.fallback not in self.models:
                raise KeyError(f"no model for {r[0]!r} and no fallback")
            wanted[self.fallback] = ~own | (F.col("territory") == self.fallback)
        out = None
        for key, mine in wanted.items():
            users = requests.filter(mine).select("user_id", "territory").distinct()
            only = users.select("user_id").distinct()
            ranked = self.models[key].recommend(interactions.join(only, "user_id", "left_semi"), features.join(only, "user_id", "left_semi") if features is not None else None, k)
            part = ranked.join(users, "user_id")
            out = part if out is None else out.unionByName(part)
        return out.select("user_id", "territory", "rank", "item_id", "score") if out is not None else None


def territory_top(interactions: DataFrame, territories: DataFrame, k: int = 10, fallback: str = "global", least: int = 1) -> DataFrame:
    """territory, rank, item_id, score: the most used items of each territory with at least `least` rows, and of all as the fallback."""
    rows = interactions.join(territories, "user_id", "left").select(F.coalesce("territory", F.lit(fallback)).alias("territory"), "item_id")
    local = rows.groupBy("territory", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    whole = local.groupBy("item_id").agg(F.sum("score").alias("score")).select(F.lit(fallback).alias("territory"), "item_id", "score")
    both = local.filter(F.col("territory") != fallback).unionByName(whole)
    sizes = both.groupBy("territory").agg(F.sum("score").alias("n")).filter(F.col("n") >= least).select("territory")
    return rank_top(both.join(sizes, "territory", "left_semi"), k, by="territory")
