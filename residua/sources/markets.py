"""Made-up markets for tests and trials. A cell's draws are hashes of the seed and its keys, so any part of a market can be made
anywhere, in any order, and comes out the same."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys: Column | int | str) -> Column:
    """A number from 0 to 1, both excluded, that depends on the keys alone."""
    bits = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return (F.shiftrightunsigned(bits, 12).cast("double") + 0.5) / float(1 << 52)


def normal(*keys: Column | int | str) -> Column:
    """A standard normal number that depends on the keys alone."""
    return F.sqrt(-2 * F.log(uniform(*keys, "radius"))) * F.cos(2 * math.pi * uniform(*keys, "angle"))


def reverting(shock: Column, keep: Column, by: str = "symbol", memory: int = 64) -> Column:
    """A sum that forgets: each row adds its shock to `keep` times the sum before; shocks more than `memory` rows old are left out."""
    recent = F.collect_list(F.struct(shock.alias("x"), keep.alias("k"))).over(Window.partitionBy(by).orderBy("t").rowsBetween(-memory, 0))
    return F.aggregate(recent, F.lit(0.0), lambda total, r: total * r["k"] + r["x"])


def _cells(spark: SparkSession, days: int, assets: int) -> DataFrame:
    return spark.range(days * assets).select((F.col("id") / assets).cast("int").alias("t"), (F.col("id") % assets).cast("int").alias("asset"))


def _moves(cells: DataFrame, factors: int, seed: int, spread: float, keep: Column, noise: float) -> DataFrame:
    """Adds symbol and move: exposures to common factors, and the change of a residual that reverts."""
    common = sum((normal(seed, "factor", k, F.col("t")) * 0.005 * (0.4 + spread * normal(seed, "exposure", k, F.col("asset"))) for k in range(factors)), F.lit(0.0))
    own = cells.withColumn("level", reverting(noise * normal(seed, "shock", F.col("t"), F.col("asset")), keep))
    before = F.coalesce(F.lag("level").over(Window.partitionBy("symbol").orderBy("t")), F.lit(0.0))
    return own.withColumn("move", common + F.col("level") - before).drop("level")


def factor_market(spark: SparkSession, days: int = 900, assets: int = 30, factors: int = 3, seed: int = 7) -> DataFrame:
    """(t, symbol, ret): returns of common factors and of residual prices that revert at a speed of each asset's own."""
    if assets <= factors:
        raise ValueError("there must be more assets than factors")
    cells = _cells(spark, days, assets).withColumn("symbol", F.format_string("A%04d", "asset"))
    moves = _moves(cells, factors, seed, 0.3, 0.75 + 0.15 * uniform(seed, "speed", F.col("asset")), 0.005)
    return moves.select("t", "symbol", F.col("move").alias("ret"))


def index_panel(spark: SparkSession, days: int = 280, assets: int = 80, seed: int = 7, start: dt.date = dt.date(2018, 1, 2), cap: float = 0.015) -> DataFrame:
    """A panel of equally weighted index members on weekdays from start: moves of at most 8 % a day, limits of 10 % either side
    of the close before, opens near that close. Too few members for weights below cap are refused."""
    if assets * cap < 1:
        raise ValueError(f"a cap of {cap:.1%} needs {math.ceil(1 / cap)} assets")
    dates = spark.range(1).select(F.posexplode(F.filter(F.sequence(F.lit(start), F.date_add(F.lit(start), 2 * days + 7)), lambda d: F.weekday(d) < 5)).alias("t", "d")).where(F.col("t") < days)
    cells = _cells(spark, days, assets).withColumn("symbol", F.format_string("%06d", F.col("asset") + 600000))
    moves = _moves(cells, 3, seed, 0.6, F.lit(0.85), 0.006).withColumn("move", F.greatest(F.lit(-0.08), F.least(F.lit(0.08), "move")))
    path = Window.partitionBy("symbol").orderBy("t")
    priced = moves.withColumn("close_price", 20 * F.exp(F.sum("move").over(path)))
    priced = priced.withColumn("before", F.coalesce(F.lag("close_price").over(path), F.lit(20.0)))
    volume = (1e6 + 5e6 * uniform(seed, "volume", F.col("t"), F.col("asset"))).alias("volume")
    flag = lambda value, name: F.lit(value).alias(name)
    return priced.join(F.broadcast(dates), "t").select(  # one row a day
        "d", "symbol", F.col("close_price").alias("adjusted_close"), (F.col("before") * F.exp(0.002 * normal(seed, "open", F.col("t"), F.col("asset")))).alias("open_price"), "close_price",
        (F.col("before") * 1.1).alias("high_limit"), (F.col("before") * 0.9).alias("low_limit"), volume, (volume * F.col("close_price")).alias("money"), flag(False, "paused"), flag(False, "is_st"), flag(True, "member"), F.lit(1.0 / assets).alias("benchmark_weight"),
    )
