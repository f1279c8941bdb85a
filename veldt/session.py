"""Sessions, tables and the shared folder where lineage is cut."""

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; every use counts the rows first.
BROADCAST_ROWS = 200_000
#: Rows of one key above which spread_join() spreads them, and over how many tasks.
HOT_ROWS, SALTS = 1_000_000, 64


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Paths of the tables that cut() wrote and nothing has deleted yet.
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own (tests); on a cluster that raises, as each
    executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="veldt-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that no lineage is left; by: a partition column.

    The files go with release(), at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldt-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    _written.add(path)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._veldt_path = path
    return back


def empty_cut(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table in the shared folder, to whose _veldt_path further rows can be appended."""
    return cut(spark.createDataFrame([], schema))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def release(*frames: DataFrame) -> None:
    """Deletes the files of tables that cut() wrote and that no later step reads."""
    for df in frames:
        if path := getattr(df, "_veldt_path", None):
            _delete(df.sparkSession, path)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    for path in list(_written) if spark else []:
        try:
            _delete(spark, path)
        except Exception:  # the engine may be gone before us
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows, counted without reading much more."""
    return df.limit(rows + 1).count() <= rows


def hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted and is small; else left to a shuffle join."""
    return F.broadcast(df) if small(df, rows) else df


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key. Keys with more than HOT_ROWS rows on the left are spread over SALTS
    tasks by the column `by`, and their rows on the right repeated, so no task holds a key of any size alone."""
    if small(left, HOT_ROWS):
        return left.join(right, on, how)
    heavy = cut(left.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS).select(on, F.lit(SALTS).alias("__salts")))
    if heavy.isEmpty():
        return left.join(right, on, how)
    heavy, many = hint(heavy), F.coalesce("__salts", F.lit(1))
    x = left.join(heavy, on, "left").withColumn("__salt", F.pmod(F.xxhash64(by), many).cast("int")).drop("__salts")
    y = right.join(heavy, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("__salts")
    return x.join(y, [on, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """df over enough partitions for CPU-bound Python, if its files make too few."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * want) if df.rdd.getNumPartitions() < 2 * want else df
