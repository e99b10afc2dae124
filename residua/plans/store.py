"""Written steps: shared by the queries of a session, so base tables are scanned once and plans stay short."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple, tuple[str, object, str | None]] = {}

#: Bytes of trades that make a bucket, and the least that is worth a task of its own.
BUCKET, LEAST = 2_000_000, 500_000


def _state(spark: SparkSession, folder: str) -> tuple:
    """What lies in a folder, by name, length and time: another state asks for other tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def key_of(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), name


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of symbols, by the bytes of the folder's trades: as many as there are cores, more where a bucket would grow large."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path).getLength() if fs.exists(path) else LEAST
    return max(1, min(spark.sparkContext.defaultParallelism, size // LEAST), -(-size // BUCKET))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset and one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="residua-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def known(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether the step's table is written for the folder as it is now."""
    return key_of(spark, sf_dir, name) in _TABLES


def stored(spark: SparkSession, sf_dir: str, name: str, plan, dealt: bool = False) -> DataFrame:
    """The step's table; plan() is run and written where this application has not yet done so for sf_dir as it is now. Tables
    of an earlier state of the folder are deleted then. All go with the application. dealt: the plan's tasks hold one bucket of
    symbols each already, as those of a kept step that moves no rows, so nothing is dealt again."""
    key = key_of(spark, sf_dir, name)
    if key not in _TABLES:
        df = plan()
        path, table = f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex}", None
        if {"t", "symbol"} <= set(df.columns) or name in ("cell", "members", "mapped"):
            # in buckets of symbols, a file each in the order of their rows: windows along a symbol and joins of symbols then
            # move and sort no rows
            n, table = buckets(spark, sf_dir), f"residua_{name}_{uuid.uuid4().hex}"
            order = next(c for c in ("t", "refit_t", "mi", "d") if c in df.columns)
            (df if dealt else df.repartition(n, "symbol")).write.bucketBy(n, "symbol").sortBy("symbol", order).option("path", path).option("compression", "zstd").saveAsTable(table)
        else:
            df.write.parquet(path)
        _drop(spark, [k for k in _TABLES if (k[0], k[1], k[3]) == (key[0], key[1], key[3])])
        _TABLES[key] = path, df.schema, table
        atexit.register(forget, spark) if len(_TABLES) == 1 else None
    path, schema, table = _TABLES[key]
    return spark.read.schema(schema).parquet(path) if table is None else spark.table(table)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str, df: DataFrame) -> Iterator[DataFrame]:
    """df written to the shared folder and read back; deleted when the block ends."""
    where = f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    try:
        yield spark.read.schema(df.schema).parquet(where)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop(spark: SparkSession, keys: list[tuple]) -> None:
    for key in keys:
        where, _, table = _TABLES.pop(key)
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Deletes all written steps of this application, if it still runs."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        _drop(spark, [k for k in _TABLES if k[0] == context.applicationId])
