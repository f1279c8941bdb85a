"""Saved models and what serving needs beside them. Everything goes through Spark's file system, whatever it is."""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.features import Transform
from veldt.operators.linear import BorderedModel, LinearModel, places, row_batch, sliced
from veldt.session import cut

#: 1: long weights and meta.json; 2: rows of weights and a meta table; 3: with the transform of raw columns; 4: rows by
#: components, written only for models that have them; 5: with the arrays of a border, likewise.
VERSION = 5


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The meta table of a saved model, or the meta.json of version 1."""
    for name in ("meta", "meta.json"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return json.loads(spark.read.option("wholetext", True).text(f"{path}/{name}").first()[0])
    raise ValueError(f"no model at {path}")


def write_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    rows = [(k, str(a.dtype), list(a.shape), bytearray(np.ascontiguousarray(a).tobytes())) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of one model, which one task has trained."""
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]).copy() for r in spark.read.parquet(f"{path}/arrays").collect()}


def check_exportable(model: LinearModel) -> None:
    """Refuses a model without items or one that fails its self-check: NaN, infinity, a diagonal, or all zero."""
    if not model.items:
        raise ValueError("the model has no items")
    if not (found := model.validate())["passed"]:
        raise ValueError(f"the model fails its self-check: {found}")


def save(model: LinearModel, path: str) -> None:
    """rows/ and meta/ under path; a model that fails its self-check is refused."""
    check_exportable(model)
    model.rows.write.mode("overwrite").parquet(f"{path}/rows")
    if bordered := isinstance(model, BorderedModel):
        write_arrays(model.spark, path, model.border)
    transform = model.transform.to_json() if model.transform else None
    write_meta(model.spark, path, {"version": 5 if bordered else 4 if model.parted else 3, "family": "linear", "items": model.items, "features": model.features, "beta": model.beta, "transform": transform})


def load(spark: SparkSession, path: str) -> LinearModel:
    """A model of any version; checks family, version, and that the weights fit the ids."""
    meta = read_meta(spark, path)
    if meta.get("family") != "linear":
        raise ValueError(f"not a linear model: {meta.get('family')}")
    items, features = meta["items"], meta["features"]
    match meta.get("version"):
        case 1:
            rows = _migrated(spark, path, items, features)
        case 2 | 3 | 4 | 5:
            rows = spark.read.parquet(f"{path}/rows")
        case other:
            raise ValueError(f"version {other} is unknown: 1 to {VERSION} are read")
    n = len(items) + len(features)
    if meta["version"] >= 4:
        fits = (F.size("at") == F.size("w")) & (F.array_max("at") < n) & F.array_contains("at", F.col("r"))
        found = rows.agg(F.count(F.lit(1)), F.countDistinct("r"), F.min("r"), F.max("r"), F.count(F.when(fits, 1))).first()
        if tuple(found) != (len(items), len(items), 0, len(items) - 1, len(items)):
            raise ValueError(f"weights do not fit {len(items)} items and {len(features)} features: {tuple(found)}")
        transform = Transform.from_json(meta["transform"]) if meta.get("transform") else None
        if meta["version"] == 5:
            border, m = read_arrays(spark, path), len(items)
            if border["label"].shape != (m,) or border["features"].shape != (m, len(features)) or border["lift"].shape != border["drop"].shape or len(border["lift"]) != m:
                raise ValueError(f"the border does not fit {m} items and {len(features)} features")
            return BorderedModel(lambda: rows, spark, border, items, features, meta["beta"], transform)
        return LinearModel(rows, items, features, meta["beta"], transform)
    found = rows.agg(F.count(F.lit(1)), F.countDistinct("r"), F.min("r"), F.max("r"), F.min(F.size("w")), F.max(F.size("w"))).first()
    if tuple(found) != ((len(items), len(items), 0, len(items) - 1, n, n) if items else (0, 0, None, None, None, None)):
        raise ValueError(f"weights do not fit {len(items)} items and {len(features)} features: {tuple(found)}")
    transform = Transform.from_json(meta["transform"]) if meta.get("transform") else None
    return LinearModel(rows, items, features, meta["beta"], transform)


def _migrated(spark: SparkSession, path: str, items: list[str], features: list[str]) -> DataFrame:
    """Rows from the long weights (r, c, w) of version 1."""
    long = spark.read.parquet(f"{path}/weights")
    sources = F.broadcast(places(spark, [f"i:{x}" for x in items] + [f"f:{x}" for x in features], "c").withColumnRenamed("k", "ck"))
    targets = F.broadcast(places(spark, items, "r").withColumnRenamed("k", "rk"))
    known = long.join(sources, "c").join(targets, "r")
    if known.count() != long.count():
        raise ValueError("weights of ids that the model does not list")
    n = len(items) + len(features)
    cells = F.map_from_entries(F.collect_list(F.when(F.col("ck").isNotNull(), F.struct("ck", "w"))))
    by_row = F.broadcast(places(spark, items, "item").withColumnRenamed("k", "rk")).join(known, "rk", "left").groupBy("rk").agg(cells.alias("m"))
    return cut(by_row.select(F.col("rk").alias("r"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.col("m")[c], F.lit(0.0))).alias("w")))


def dense(model: LinearModel) -> np.ndarray:
    """The weights of the bounded model: a row per item, beta folded into the columns of features."""
    n = len(model.items) + len(model.features)
    t = model.dense_rows().orderBy("r").toArrow()
    s = t["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, n).copy() if t.num_rows else np.zeros((0, n))
    s[:, len(model.items) :] *= model.beta
    return s


def payload(model: LinearModel) -> dict:
    """items, features and s: little-endian doubles, row by row (item rows; item and feature columns, beta folded in).

    All in one on the driver; payload_rows() gives the same as a table.
    """
    check_exportable(model)
    return {"items": model.items, "features": model.features, "s": dense(model).astype("<f8").tobytes()}


def payload_rows(model: LinearModel) -> DataFrame:
    """The payload by rows, for models that the driver should not hold: item (its place) and s, its row as in payload()."""
    check_exportable(model)
    m, beta = len(model.items), model.beta

    def run(batches):
        for r, a in sliced(batches):
            a = a.copy()
            a[:, m:] *= beta
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array([x.tobytes() for x in a.astype("<f8")], pa.binary())], ["item", "s"])

    return model.dense_rows().mapInArrow(run, "item int, s binary")


def quantise(weights: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """fp16 or int8 weights and the scale of each row."""
    if kind == "fp16":
        return weights.astype(np.float16), np.ones(len(weights))
    if kind == "int8":
        scale = np.maximum(np.abs(weights).max(1, initial=0.0), 1e-12) / 127
        return np.round(weights / scale[:, None]).astype(np.int8), scale
    raise ValueError(f"unknown kind {kind}")


def quantised(model: LinearModel, kind: str, least: float | None = None, k: int = 10) -> LinearModel:
    """The model with weights as after quantise(), row by row in the workers. With `least`, a mean rank agreement below it raises."""
    quantise(np.zeros((0, 1)), kind)  # an unknown kind raises here
    m, beta = len(model.items), model.beta

    def run(batches):
        for r, a in sliced(batches):
            a = a.copy()
            a[:, m:] *= beta
            q, scale = quantise(a, kind)
            yield row_batch(r, q.astype(float) * scale[:, None])

    rows = cut(model.dense_rows().mapInArrow(run, "r int, w array<double>"))
    out = LinearModel(rows, model.items, model.features, 1.0, model.transform)
    if least is not None:
        row = rank_agreement(model, out, k).agg(F.avg("agreement")).first()[0]
        if row is not None and row < least:
            raise ValueError(f"rank agreement {row:.3f} is below {least}")
    return out


def rank_agreement(model: LinearModel, other: LinearModel, k: int = 10) -> DataFrame:
    """item, agreement: the share of an item's k nearest that both models give."""
    a, b = (m.neighbours(k).select("item", "item_id") for m in (model, other))
    both = a.join(b.withColumn("hit", F.lit(1)), ["item", "item_id"], "left")
    return both.groupBy("item").agg((F.count("hit") / F.count(F.lit(1))).alias("agreement"))


def vocabulary(model: LinearModel, folder: str) -> str:
    """Writes vocab.json (a folder with one text file, as Spark writes it): item and feature keys in index order."""
    check_exportable(model)
    path = f"{folder}/vocab.json"
    text = json.dumps({"item_index_to_guid": model.items, "feature_index_to_key": model.features})
    model.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_and_predict(spark: SparkSession, path: str, interactions: DataFrame, features: DataFrame | None = None, k: int = 100, **options) -> DataFrame:
    """recommend() of a saved linear model."""
    return load(spark, path).recommend(interactions, features, k, **options)


def serve(model: LinearModel, requests: DataFrame, k: int = 10, rho: float | DataFrame = 0.0, default_rho: float = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """user_row, rank, item_guid, score for requests (user_row, interactions map, features map): scores less rho for seen items.

    A request may also hold `seen` (an array of items, in force beside those of its interactions) and `rho`. The penalty
    is the request's own, else the user's in the table rho (user_id, rho; by the request's user_id column, or user_row
    where there is none), else default_rho (rho itself if it is a number). mask is that of LinearModel.recommend.
    """
    user = F.col("user_row").cast("string").alias("user_id")
    rows = requests.withColumn("__id", F.col("user_id" if "user_id" in requests.columns else "user_row").cast("string"))
    x = rows.select(user, F.explode("interactions").alias("item_id", "value"))
    u = rows.select(user, F.explode("features").alias("feature_name", "value"))
    seen = rows.select(user, F.explode("seen").alias("item_id")) if "seen" in requests.columns else None
    own = F.col("rho").cast("double") if "rho" in requests.columns else F.lit(None).cast("double")
    chain = rows.select(user, "__id", own.alias("own"))
    if isinstance(rho, (int, float)):
        chain = chain.select("user_id", F.coalesce("own", F.lit(float(rho))).alias("rho"))
    else:
        table = rho.select(F.col("user_id").cast("string").alias("__id"), F.col("rho").cast("double").alias("learned"))
        chain = chain.join(table, "__id", "left").select("user_id", F.coalesce("own", "learned", F.lit(float(default_rho))).alias("rho"))
    ranked = model.recommend(x, u, k, exclude_seen=False, seen=seen, rho=chain, mask=mask, users=rows.select(user))
    return ranked.select(F.col("user_id").alias("user_row"), "rank", F.col("item_id").alias("item_guid"), "score")
