"""What the corpus operators share: the shared folder, written tables, range buckets and row numbers.

Every operator reads only the columns it is told to read, so extra columns of any name in its
input never clash with its own.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_ID = -(1 << 63)  # stands for a null id where a key must not be null
HELD: list[dict] = []  # tables that a Python worker keeps between tasks of one kind


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`; unset, one of our own on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a no-op where it is installed)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def give_back() -> None:
    """Empty what this Python worker holds and return its memory to the system: workers outlive their tasks and count in an executor's memory."""
    for table in HELD:
        table.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches, after which the worker gives memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values of the non-null long column `key` that split its rows about evenly.

    The only data read is the key column; the driver gets `parts` numbers.
    """
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.select(F.percentile_approx(key, F.array(*map(F.lit, probs)), F.lit(max(10000, 20 * parts))).alias("b")).first()
    return sorted(set(row.b or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are less than key: bucket i holds the keys in (bounds[i-1], bounds[i]].

    Looks first among every width-th bound, then among the width bounds between two of those.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    tops = F.array(*[F.lit(bounds[i]).cast("long") for i in range(width - 1, len(bounds), width)]) if len(bounds) >= width else F.array()
    coarse = F.size(F.filter(tops, lambda b: b < key)) * width
    fine = F.size(F.filter(F.slice(F.array(*[F.lit(b).cast("long") for b in bounds]), coarse + 1, F.lit(width)), lambda b: b < key))
    return coarse + fine


def partitions_for(rows_or_bytes: int, each: int, least: int = 1, most: int = 20000) -> int:
    return int(min(most, max(least, -(-rows_or_bytes // each))))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, per_bucket: int = 1_000_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column `out` (long).

    A group may hold most of the rows, so each is cut by the hash of `order` into buckets of about `per_bucket`
    rows; rows are numbered inside a bucket and shifted by the sizes of the buckets before it. Only bucket sizes
    are added up per group.
    """
    n = partitions_for(rows, per_bucket, 1, 1 << 20)
    df = df.withColumn("_nb", F.pmod(F.xxhash64(*order), F.lit(n)))
    rank = Window.partitionBy(*group, "_nb").orderBy(*order)
    df = df.withColumn("_nr", F.row_number().over(rank).cast("long") - 1)
    if n == 1:
        return df.withColumn(out, F.col("_nr")).drop("_nb", "_nr")
    sizes = df.groupBy(*group, "_nb").agg(F.count(F.lit(1)).alias("_nc"))
    before = Window.partitionBy(*group).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_no", F.coalesce(F.sum("_nc").over(before), F.lit(0))).drop("_nc")
    return df.join(offsets, [*group, "_nb"]).withColumn(out, F.col("_no") + F.col("_nr")).drop("_nb", "_nr", "_no")
