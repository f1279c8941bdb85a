"""The framed binary file of a linear model, for models that come from or go to other programs.

Little-endian throughout: a signature, then fields in a fixed order. Texts and lists carry their length first; an optional
field has one byte that tells whether it follows.
"""

import io
import os
import struct
import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from veldt.operators.linear import PIECE_BYTES, SOLVE_BYTES, LinearModel, row_batch, transposed
from veldt.session import cut, empty_cut, release
from veldt.sources.persist import check_exportable

# The signature, the versions that exist, and the order of the fields.
SIGNATURE = b"FEAS"
VERSIONS = (1, 2, 3)
COUNTS = ("items", "user_features", "item_features")
NUMBERS = ("alpha", "beta", "lambda", "meta_weight")
IDS = ("user", "item", "user_feature", "item_feature")
WEIGHTING = ("decay_rate", "ips_alpha", "sparsity_threshold")


@dataclass
class Framed:
    """What a file holds: the square weights over items and, after them, user features; ids in order; parameters."""

    weights: np.ndarray
    ids: dict[str, list[str]]
    numbers: dict[str, float]
    version: int = 3
    weighting: dict | None = None
    #: The encoded transform of version 3, taken over as it stands (one zero byte: none).
    tail: bytes = field(default=b"\0")


class _Reader:
    """Reads from a binary stream."""

    def __init__(self, stream):
        self.stream = stream

    def bytes(self, n: int) -> bytes:
        if len(got := self.stream.read(n)) < n:
            raise ValueError("the file ends too early")
        return got

    def one(self, kind: str):
        return struct.unpack("<" + kind, self.bytes(struct.calcsize("<" + kind)))[0]

    def text(self) -> str:
        return self.bytes(self.one("Q")).decode()

    def many(self, item) -> list:
        return [item() for _ in range(self.one("Q"))]

    def optional(self, item):
        return item() if self.one("B") else None


def _head(r: _Reader) -> tuple[int, int, int]:
    """Version, height and width; checks the signature, the version, and that the matrix fits its own size."""
    if r.stream.read(4) != SIGNATURE:
        raise ValueError("not a model file")
    version = r.one("I")
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version}")
    height, width = r.one("Q"), r.one("Q")
    cells = r.one("Q")
    if cells != height * width:
        raise ValueError(f"{cells} cells are no matrix of {height} times {width}")
    return version, height, width


def _after(r: _Reader, version: int, height: int, width: int) -> Framed:
    """What follows the matrix, which stays empty; checks that the matrix fits the numbers of ids."""
    counts = {c: r.one("Q") for c in COUNTS}
    if height != width or height != counts["items"] + counts["user_features"]:
        raise ValueError(f"a matrix of {height} times {width} does not fit {counts}")
    numbers = {c: r.one("d") for c in NUMBERS}
    ids = {}
    for c in IDS:
        r.many(lambda: (r.text(), r.one("Q")))  # the same ids with their places
        ids[c] = r.many(r.text)
    weighting = None
    if version >= 2:
        weighting = r.optional(lambda: {"event_weights": r.optional(lambda: dict(r.many(lambda: (r.text(), r.one("d")))))} | {c: r.one("d") for c in WEIGHTING})
    return Framed(np.zeros((0, 0)), ids, numbers, version, weighting, r.stream.read())


def decode(data: bytes) -> Framed:
    """Checks signature, version, and that the matrix fits its own size and the numbers of ids."""
    r = _Reader(io.BytesIO(data))
    version, height, width = _head(r)
    weights = np.frombuffer(r.bytes(8 * height * width), "<f8").reshape((height, width), order="F")
    f = _after(r, version, height, width)
    f.weights = weights
    return f


def encode(f: Framed) -> bytes:
    before, after = _around(f, *f.weights.shape)
    return b"".join([before, f.weights.astype("<f8").tobytes(order="F"), after])


def _around(f: Framed, height: int, width: int) -> tuple[bytes, bytes]:
    """What stands before and after the matrix."""
    out = [SIGNATURE]
    put = lambda kind, *x: out.append(struct.pack("<" + kind, *x))

    def text(s: str) -> None:
        b = s.encode()
        put("Q", len(b))
        out.append(b)

    put("IQQQ", f.version, height, width, height * width)
    before = b"".join(out)
    out.clear()
    put("QQQ", *(len(f.ids[c]) for c in ("item", "user_feature", "item_feature")))
    put("dddd", *(f.numbers[c] for c in NUMBERS))
    for c in IDS:
        put("Q", len(f.ids[c]))
        for k, s in enumerate(f.ids[c]):
            text(s)
            put("Q", k)
        put("Q", len(f.ids[c]))
        for s in f.ids[c]:
            text(s)
    if f.version >= 2:
        put("B", f.weighting is not None)
        if f.weighting is not None:
            events = f.weighting.get("event_weights")
            put("B", events is not None)
            if events is not None:
                put("Q", len(events))
                for k, v in events.items():
                    text(k)
                    put("d", v)
            put("ddd", *(f.weighting.get(c, 0.0) for c in WEIGHTING))
    if f.version >= 3:
        out.append(f.tail)
    return before, b"".join(out)


def _local(spark: SparkSession, path: str):
    """The file system of a path, the path, and a place on the driver's disk, both as it takes them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle, local = tempfile.mkstemp(prefix="veldt-")
    os.close(handle)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, local, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}")


def read_binary(spark: SparkSession, path: str) -> LinearModel:
    """The linear model in a file, wherever Spark can read; one that a solve could not hold is refused.

    The file passes over the driver's disk; half of PIECE_BYTES of its columns at a time becomes a table, which the workers turn.
    """
    fs, p, local, q = _local(spark, path)
    columns = None
    try:
        if (size := fs.getFileStatus(p).getLen()) > SOLVE_BYTES:
            raise ValueError(f"a file of {size} bytes")
        fs.copyToLocalFile(False, p, q, True)
        with open(local, "rb") as stream:
            r = _Reader(stream)
            version, height, width = _head(r)
            if 8 * height * width > size:
                raise ValueError("the file ends too early")
            at = stream.tell()
            stream.seek(8 * height * width, os.SEEK_CUR)
            f = _after(r, version, height, width)
            m = len(f.ids["item"])
            columns = empty_cut(spark, "r int, w array<double>")
            stream.seek(at)
            step = max(1, PIECE_BYTES // (16 * max(height, 1)))
            for lo in range(0, width if m else 0, step):
                n = min(step, width - lo)
                part = np.frombuffer(r.bytes(8 * height * n), "<f8").reshape(n, height)[:, :m]
                rows = pa.Table.from_batches([row_batch(lo + np.arange(n), part)])
                spark.createDataFrame(rows, "r int, w array<double>").coalesce(1).write.mode("append").parquet(columns._veldt_path)
    finally:
        os.unlink(local)
    rows = cut(transposed(spark.read.schema(columns.schema).parquet(columns._veldt_path), width))
    release(columns)
    return LinearModel(rows, f.ids["item"], f.ids["user_feature"], f.numbers["beta"])


def write_binary(model: LinearModel, path: str, **numbers: float) -> None:
    """Writes the file through Spark's file system. Rows of features, which are never a target, are zero.

    The workers turn rows into columns, which reach the driver's disk half of PIECE_BYTES at a time.
    """
    check_exportable(model)
    spark, m, n = model.spark, len(model.items), len(model.items) + len(model.features)
    given = {"alpha": 1.0, "beta": model.beta, "lambda": 0.0, "meta_weight": 0.0} | {k.rstrip("_"): v for k, v in numbers.items()}
    before, after = _around(Framed(np.zeros((0, 0)), {"user": [], "item": model.items, "user_feature": model.features, "item_feature": []}, given), n, n)
    step = max(1, PIECE_BYTES // (16 * max(m, 1)))
    columns = cut(transposed(model.dense_rows(), m))
    fs, p, local, q = _local(spark, path)
    try:
        with open(local, "wb") as stream:
            stream.write(before)
            for lo in range(0, n, step):
                part = np.zeros((min(step, n - lo), n))
                t = columns.filter(f"r >= {lo} and r < {lo + step}").toArrow()
                part[t["r"].to_numpy() - lo, :m] = t["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, m)
                stream.write(part.astype("<f8").tobytes())
            stream.write(after)
        fs.copyFromLocalFile(False, True, q, p)
    finally:
        os.unlink(local)
    release(columns)
