"""Panels built from a provider's long tables: calendar, members as of the day before each month, bars, weights and limits."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.sources.panels import FIELDS, ProviderError, drain

# Flags of a provider's price adjustments, the fields of a bar, limits in percent by exchange and board, the day
# on which one board's limits changed, how long a share count is carried, the least number of names under a cap of 1.5 %.
ADJUSTMENTS = {"post": "1", "pre": "2", "none": "3"}
BAR_FIELDS = "date,code,open,high,low,close,preclose,volume,amount,adjustflag,turn,tradestatus,pctChg,isST"
WIDE_BOARDS, OPENED_BOARDS, OPENED_ON = ("sh.688", "sh.689"), ("sz.300", "sz.301"), dt.date(2020, 8, 24)
SHARES_CARRIED, LEAST_SYMBOLS = 120, 67


class FreeProvider:
    """A session with a provider that answers by cursors of strings; its client is given. Used as a context, it logs in and out."""

    def __init__(self, client):
        self.client, self.open = client, False

    def __enter__(self) -> FreeProvider:
        answer = self.client.login()
        if str(answer.error_code) != "0":
            raise ProviderError(f"login: {answer.error_code} {answer.error_msg}")
        self.open = True
        return self

    def __exit__(self, *_: object) -> None:
        if self.open:
            self.client.logout()
        self.open = False

    def _ask(self, operation: str, query: Callable, *args: object, **named: object) -> pd.DataFrame:
        if not self.open:
            raise ProviderError(f"{operation}: no session is open")
        return drain(query(*args, **named), operation)

    def calendar(self, start: str, end: str) -> list[str]:
        days = self._ask("calendar", self.client.query_trade_dates, start_date=start, end_date=end)
        return sorted(days.loc[days["is_trading_day"] == "1", "calendar_date"]) if len(days) else []

    def members(self, day: str) -> list[str]:
        names = self._ask("members", self.client.query_zz500_stocks, date=day)
        if not len(names) or "code" not in names:
            raise ProviderError(f"members: none on {day}")
        return sorted(names["code"])

    def history(self, symbol: str, start: str, end: str, adjustment: str = "none") -> pd.DataFrame:
        if adjustment not in ADJUSTMENTS:
            raise ValueError(f"the adjustment is one of {', '.join(ADJUSTMENTS)}")
        return self._ask(f"history of {symbol}", self.client.query_history_k_data_plus, symbol, BAR_FIELDS, start_date=start, end_date=end, frequency="d", adjustflag=ADJUSTMENTS[adjustment])


class LicensedProvider:
    """A client behind a login of one's own; weights come as published, prices as they were traded and adjusted afterwards."""

    def __init__(self, client, user: str, password: str):
        client.auth(user, password)
        if not client.is_auth():
            raise ProviderError("the login was refused")
        self.client = client

    def calendar(self, start: str, end: str) -> list[str]:
        return sorted(str(d)[:10] for d in self.client.get_trade_days(start_date=start, end_date=end))

    def weights(self, index: str, day: str) -> pd.DataFrame:
        """(as_of, symbol, weight) of the published weights above 0, which must be some."""
        told = self.client.get_index_weights(index, date=day)
        if told is None or not len(told) or "weight" not in told.columns:
            raise ProviderError(f"weights: none of {index} on {day}")
        names = told["code"] if "code" in told.columns else told.index
        out = pd.DataFrame({"as_of": day, "symbol": [str(s) for s in names], "weight": told["weight"].astype(float).to_numpy()})
        out = out[out["weight"] > 0]
        if not len(out):
            raise ProviderError(f"weights: no positive ones of {index} on {day}")
        return out


def month_ends_before(days: DataFrame, start: dt.date) -> DataFrame:
    """(month, first_day, as_of): for each month of the calendar `days` (d) from start, the last day before its first one from
    start. A first month without an earlier day is refused."""
    months = days.where(F.col("d") >= F.lit(start)).groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.min("d").alias("first_day"))
    order = Window.orderBy("d")  # one row a day
    before = days.select("d", F.lag("d").over(order).alias("as_of"))
    out = months.join(before, F.col("first_day") == F.col("d"), "left").select("month", "first_day", "as_of")
    lost = out.where("as_of is null").first()
    if lost:
        raise ValueError(f"the calendar has no day before {lost['first_day']}")
    return out


def cached_bars(spark: SparkSession, folder: str, symbols: list[str], start: str, end: str, fetch: Callable[[str], pd.DataFrame], adjustment: str = "none", block: int = 100) -> DataFrame:
    """Bars of symbols as strings, with symbol and ordinal (the order of the answer), through a cache: what no earlier call with
    this span and adjustment has asked for is fetched on the driver, as a provider allows one session, and written a block of
    symbols at a time. A block counts once its list of symbols, empty answers included, stands beside it."""
    place = f"{folder}/{adjustment}/{start.replace('-', '')}_{end.replace('-', '')}"
    known = _asked(spark, place)
    missing = [s for s in symbols if s not in known]
    for lo in range(0, len(missing), block):
        part = missing[lo : lo + block]
        frames = [(s, fetch(s)) for s in part]
        columns = BAR_FIELDS.split(",")
        rows = [(s, i, *[None if pd.isna(v) else str(v) for v in r]) for s, f in frames for i, r in enumerate(f.reindex(columns=columns).itertuples(index=False))]
        at = f"{place}/{uuid.uuid4().hex}"
        spark.createDataFrame(rows, "symbol string, ordinal long, " + ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.parquet(f"{at}/bars")
        spark.createDataFrame([(s, at) for s in part], "symbol string, at string").coalesce(1).write.parquet(f"{place}/asked/{at.rpartition('/')[2]}")
        known |= dict.fromkeys(part, at)
    folders = sorted({known[s] for s in symbols})
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return spark.read.parquet(*[f"{at}/bars" for at in folders]).join(F.broadcast(wanted), "symbol", "left_semi")  # names on the driver already


def _asked(spark: SparkSession, place: str) -> dict[str, str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/asked")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return {}
    return {r["symbol"]: r["at"] for r in spark.read.parquet(f"{place}/asked/*").collect()}


def _number(name: str) -> Column:
    return F.expr(f"try_cast(nullif({name}, '') AS double)").alias(name)


def percent_limit(symbol: Column, day: Column, is_st: Column) -> Column:
    """The daily limit in percent, by exchange, board, day and special treatment."""
    starts = lambda names: F.substring(symbol, 1, 6).isin(*names)
    rate = F.when(starts(WIDE_BOARDS), 20).when(starts(OPENED_BOARDS) & (day >= F.lit(OPENED_ON)), 20).when(symbol.startswith("bj."), 30)
    return F.coalesce(rate, F.when(is_st, 5).otherwise(10))


def cents_limit(price: Column, percent: Column) -> Column:
    """The price moved by percent, in whole cents, halves up, without a product of fractions."""
    return F.floor((F.round(price * 100).cast("long") * (100 + percent) + 50) / 100) / 100


def panel_from_bars(bars: DataFrame, calendar: DataFrame, members: DataFrame, start: dt.date, max_symbols: int | None = None) -> DataFrame:
    """The panel (d, symbol, FIELDS) from start on, of all symbols that are members in some month.

    bars: symbol, ordinal and strings date, open, close, preclose, volume, amount, turn, tradestatus, pctChg, isST; of several
    bars a day the last by ordinal counts. calendar: d, also of days before start. members: as_of, symbol, for the last day
    before each month. Members weigh their float value (close times volume over turnover, the share count carried for 120
    days), members without one the median of the others; max_symbols keeps the first names of each snapshot, weighed alike.
    """
    if max_symbols is not None and max_symbols < LEAST_SYMBOLS:
        raise ValueError(f"max_symbols must be at least {LEAST_SYMBOLS}")
    months = month_ends_before(calendar, start)
    taken = members.select(F.col("as_of").cast("date").alias("as_of"), "symbol").distinct().join(F.broadcast(months.select("month", "as_of")), "as_of")
    if max_symbols is not None:
        taken = taken.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy("symbol"))).where(F.col("place") <= max_symbols).drop("place")
    days = calendar.select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("t"), F.date_format("d", "yyyy-MM").alias("month"))  # one row a day
    latest = Window.partitionBy("symbol", "d").orderBy(F.col("ordinal").desc())
    typed = bars.select("symbol", "ordinal", F.to_date("date").alias("d"), *[_number(c) for c in ("open", "close", "preclose", "volume", "amount", "turn", "tradestatus", "pctChg", "isST")])
    typed = typed.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", "ordinal")
    grid = taken.select("symbol").distinct().crossJoin(F.broadcast(days)).join(typed, ["symbol", "d"], "left")  # the calendar: one row a day
    history = Window.partitionBy("symbol").orderBy("t")
    inside = Window.partitionBy("symbol", F.col("d") >= F.lit(start)).orderBy("t")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    shares = F.when((F.col("turn") > 0) & (F.col("volume") / (F.col("turn") / 100)).isNotNull(), F.col("volume") / (F.col("turn") / 100))
    everything = Window.partitionBy("symbol")
    wide = grid.withColumn("shares", shares).withColumns({
        "index": F.exp(F.sum(F.log1p(F.coalesce("pctChg", F.lit(0.0)) / 100)).over(history)), "value": last("close", history),
        "counted": F.when(F.col("t") - last(F.when(F.col("shares").isNotNull(), F.col("t")), history) <= SHARES_CARRIED, last("shares", history)),
        "first_t": F.min(F.when(F.col("close").isNotNull(), F.col("t"))).over(everything), "last_t": F.max(F.when(F.col("close").isNotNull(), F.col("t"))).over(everything),
        "is_st": F.coalesce(last("isST", inside) == 1, F.lit(False)), "close_price": last("close", inside), "open_price": last("open", inside), "before": last("preclose", inside),
    })
    caps = wide.select("symbol", F.col("d").alias("as_of"), (F.col("value") * F.col("counted")).alias("cap"))
    caps = taken.join(caps, ["symbol", "as_of"], "left").withColumn("cap", F.when(F.col("cap") > 0, F.col("cap")))
    middle = caps.groupBy("month").agg(F.median("cap").alias("middle"))
    month = Window.partitionBy("month")
    size = F.coalesce("cap", "middle", F.lit(1.0)) if max_symbols is None else F.lit(1.0)
    weights = caps.join(F.broadcast(middle), "month").withColumn("size", size).select("month", "symbol", (F.col("size") / F.sum("size").over(month)).alias("weight"), F.col("cap").isNotNull().alias("valued"))
    percent = percent_limit(F.col("symbol"), F.col("d"), F.col("is_st"))
    panel = wide.where(F.col("d") >= F.lit(start)).join(weights, ["month", "symbol"], "left")
    return panel.select(
        "d", "symbol", F.when(F.col("t").between(F.col("first_t"), F.col("last_t")), F.col("index")).alias("adjusted_close"), "open_price", "close_price",
        cents_limit(F.col("before"), percent).alias("high_limit"), cents_limit(F.col("before"), -percent).alias("low_limit"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("amount", F.lit(0.0)).alias("money"),
        (F.coalesce("tradestatus", F.lit(0.0)) != 1).alias("paused"), "is_st", F.col("weight").isNotNull().alias("member"), F.coalesce("weight", F.lit(0.0)).alias("benchmark_weight"),
    )


def panel_from_tables(raw: DataFrame, adjusted: DataFrame, st: DataFrame, calendar: DataFrame, weights: DataFrame, start: dt.date) -> DataFrame:
    """The panel from a licensed provider's long tables.

    raw: symbol, d, open, close, volume, money, high_limit, low_limit, paused; adjusted: symbol, d, close; st: symbol, d, is_st;
    repeated rows of a day must agree, else the larger values count. weights: as_of, symbol, weight of the last day before
    each month; only those above 0 count, scaled to 1. A day without a raw bar has nulls and is paused.
    """
    months = month_ends_before(calendar, start)
    held = weights.where("weight > 0").select(F.col("as_of").cast("date").alias("as_of"), "symbol", "weight").join(F.broadcast(months.select("month", "as_of")), "as_of")
    held = held.select("month", "symbol", (F.col("weight") / F.sum("weight").over(Window.partitionBy("month"))).alias("weight"))
    lacking = months.join(held.select("month").distinct(), "month", "left_anti").first()
    if lacking:
        raise ValueError(f"no member has a weight for {lacking['month']}")
    one = lambda df, *columns: df.groupBy("symbol", "d").agg(*[F.max(c).alias(n) for c, n in columns])
    days = calendar.where(F.col("d") >= F.lit(start)).select("d", F.date_format("d", "yyyy-MM").alias("month"))
    grid = held.select("symbol").distinct().crossJoin(F.broadcast(days))  # one row a day
    bars = one(raw, ("open", "open_price"), ("close", "close_price"), ("high_limit", "high_limit"), ("low_limit", "low_limit"), ("volume", "volume"), ("money", "money"), ("paused", "paused"))
    wide = grid.join(bars, ["symbol", "d"], "left").join(one(adjusted, ("close", "adjusted_close")), ["symbol", "d"], "left").join(one(st, ("is_st", "is_st")), ["symbol", "d"], "left").join(held, ["month", "symbol"], "left")
    flags = {"paused": F.coalesce(F.col("paused").cast("boolean"), F.lit(True)), "is_st": F.coalesce(F.col("is_st").cast("boolean"), F.lit(False)), "member": F.col("weight").isNotNull(), "benchmark_weight": F.coalesce("weight", F.lit(0.0))}
    return wide.withColumns(flags).select("d", "symbol", *FIELDS)


def coverage(panel: DataFrame, bars: DataFrame) -> dict:
    """What a manifest says of a build: names, members a month, and the share of members' days with a bar."""
    row = panel.where("member").agg(F.countDistinct("symbol").alias("names"), F.count(F.lit(1)).alias("member_days"), F.avg((~F.col("paused")).cast("int")).alias("traded")).first()
    return row.asDict() | {"bars": bars.count()}
