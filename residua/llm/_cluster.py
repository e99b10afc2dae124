"""Scratch storage that every executor can reach, and skew-safe group reductions."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local one stands in only where that is unset and one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="residua-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/residua/{tag}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while written() runs: texts are long, and both sides of a worker's pipe hold a batch.
BATCH_ROWS = 1000


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch_path(spark, tag), spark.conf.get(setting)
    spark.conf.set(setting, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def released(run: Callable) -> Callable:
    """run, a function over Arrow batches; what its worker no longer uses goes back to the system when a task ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """What this worker no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote for them, once nothing lazy reads it any more.

    The driver is asked to collect its garbage then: Spark deletes the shuffle files of a finished query only when the
    driver's references to it are gone, by default half an hour later, and they are as large as the tables."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def group_extreme(df: DataFrame, keys: list[str], value: str, out: str, *, largest: bool = False, count: str | None = None) -> DataFrame:
    """Add each group's smallest (or largest) value as a column, however large one group is.

    Both the reduction and the join back are keyed by (keys, salt), so a key that holds a third of all rows is spread
    over SALTS tasks; only (group, salt) partial results meet under the bare key. count names an optional column with
    the number of rows in the group. Null keys are a group of their own.
    """
    pick = F.max if largest else F.min
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(value), F.lit(7)), F.lit(SALTS)).cast("int"))
    partial = salted.groupBy(*keys, "_salt").agg(pick(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    whole = partial.groupBy(*keys).agg(pick("_v").alias(out), F.sum("_n").alias("_rows"), F.collect_set("_salt").alias("_salts"))
    whole = whole.withColumn("_salt_r", F.explode("_salts")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_salt_r", out, "_rows")
    on: Column = F.col("_salt") == F.col("_salt_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # null-safe keys take the default coalesce-and-isnull form, which still hashes by key
    joined = salted.join(whole, on, "inner").drop("_salt", "_salt_r", *[f"_k{i}" for i in range(len(keys))])
    return joined.withColumnRenamed("_rows", count) if count else joined.drop("_rows")


#: Rows of a side that may be broadcast; larger sides are joined by a shuffle.
RESIDENT_ROWS = 2_000_000


def checked(df: DataFrame, rows: int = RESIDENT_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else df as it is. df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns _id, _crc, _size that tell rows of the same id with different texts apart."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return [F.col(id_col).alias("_id"), F.crc32(raw).alias("_crc"), F.octet_length(raw).alias("_size")]


def without(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less the rows named (_id, _crc, _size); all columns stay as they are, whatever their names."""
    return _matched(docs, named, id_col, text_col, "left_anti")


def only(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are named (_id, _crc, _size), with all columns as they are."""
    return _matched(docs, named, id_col, text_col, "left_semi")


def _matched(docs: DataFrame, named: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    left, right = unused(docs, "_l0", "_l1", "_l2"), unused(docs, "_r0", "_r1", "_r2")
    wide = docs.select("*", *[c.alias(n) for n, c in zip(left, row_key(id_col, text_col))])
    rows = checked(named.select(*[F.col(c).alias(n) for n, c in zip(right, ("_id", "_crc", "_size"))]).distinct())
    on = F.col(left[0]).eqNullSafe(F.col(right[0])) & (F.col(left[1]) == F.col(right[1])) & (F.col(left[2]) == F.col(right[2]))
    return wide.join(rows, on, how).drop(*left)
