"""Panels: written with a manifest and a fingerprint, loaded and checked against them, and read from providers through a cache."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.sources.arrays import BLOCK_BYTES, PanelSource
from residua.sources.reports import read_text, write_text

FIELDS = "adjusted_close open_price close_price high_limit low_limit volume money paused is_st member benchmark_weight".split()
HOLDOUT = dt.date(2023, 1, 1)


def fingerprint(panel: DataFrame) -> str:
    """A digest of all cells that does not depend on the order of rows: SHA-256 over per-row digests summed in parts."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("d", "symbol", *FIELDS)]
    row = F.sha2(F.concat_ws("\x1f", *cells), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}")
    sums = panel.agg(F.count(F.lit(1)).alias("n"), *[part(i) for i in range(8)]).first()
    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()


def audit(panel: DataFrame) -> dict:
    """Counts and rates of a panel, with its fingerprint."""
    member = F.col("member").cast("double")
    rate = lambda c: (F.sum(F.when(F.col("member") & c, 1.0).otherwise(0.0)) / F.sum(member))
    row = panel.agg(
        F.min("d").cast("string").alias("start_date"), F.max("d").cast("string").alias("end_date"), F.countDistinct("d").alias("trading_days"), F.countDistinct("symbol").alias("symbols"), F.sum(member).cast("long").alias("member_observations"),
        rate(F.col("adjusted_close").isNull()).alias("missing_adjusted_close_rate"), rate(F.col("open_price").isNull()).alias("missing_open_rate"), rate(F.col("paused")).alias("paused_rate"), rate(F.col("is_st")).alias("st_rate"),
        rate(F.col("high_limit").isNull() | F.col("low_limit").isNull()).alias("missing_limit_rate"),
    ).first()
    weights = panel.groupBy("d").agg(F.sum("benchmark_weight").alias("w")).where("abs(w - 1) > 1e-6").count()
    return row.asDict() | {"invalid_weight_days": weights, "fingerprint": fingerprint(panel)}


def save_panel(panel: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """Writes the panel by month, and beside it a manifest with its audit; returns the manifest. Days and symbols must be unique."""
    if panel.groupBy("d", "symbol").count().where("count > 1").limit(1).count():
        raise ValueError("a panel has one row per day and symbol")
    panel.withColumn("month", F.date_format("d", "yyyy-MM")).repartition("month").write.mode("errorifexists").partitionBy("month").parquet(f"{path}/cells")
    manifest = {"audit": audit(panel), "metadata": metadata or {}, "columns": panel.columns}
    write_text(panel.sparkSession, f"{path}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, default=str))
    return manifest


def load_panel(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """The panel written by save_panel(); check compares its fingerprint with the manifest's."""
    manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    panel = spark.read.parquet(f"{path}/cells").select(*manifest["columns"])
    if check and fingerprint(panel) != manifest["audit"]["fingerprint"]:
        raise ValueError(f"the panel in {path} is not the one its manifest describes")
    return panel


def load_arrays(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A panel stored as .npz arrays (dates, symbols, and day-by-symbol matrices); a task reads block_bytes of days."""
    spark.dataSource.register(PanelSource)
    ddl = "d date, symbol string, " + ", ".join(f"{c} {'boolean' if c in ('paused', 'is_st', 'member') else 'double'}" for c in FIELDS)
    return spark.read.format("npz_panel").schema(ddl).option("blockBytes", block_bytes).load(path)


def sealed(panel: DataFrame, holdout: dt.date = HOLDOUT) -> DataFrame:
    """The panel, if it ends before the sealed holdout."""
    last = panel.agg(F.max("d").alias("d")).first()["d"]
    if last is not None and last >= holdout:
        raise ValueError(f"the panel reaches {last}; data from {holdout} on is sealed")
    return panel


class ProviderError(RuntimeError):
    """A provider answered with an error code."""


def drain(result, operation: str) -> pd.DataFrame:
    """All rows of a provider's cursor (error_code, error_msg, fields, next(), get_row_data()) as strings."""
    if result.error_code != "0":
        raise ProviderError(f"{operation}: {result.error_code} {result.error_msg}")
    rows = []
    while result.next():
        rows.append(result.get_row_data())
    return pd.DataFrame(rows, columns=list(result.fields), dtype=str)
