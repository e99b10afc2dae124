"""Small functions over columns and tables that several parts of a study need."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether a lies within atol + rtol * |b| of b; infinities are close to themselves, NaN to nothing, null gives null."""
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    return F.when(a == b, ~F.isnan(a)).otherwise(near & ~F.isnan(a) & ~F.isnan(b) & (F.abs(b) < float("inf")))


def finite(c: Column, otherwise: float = 0.0) -> Column:
    """c as double, with another value for null, NaN and infinities."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(otherwise))


def clip_day(day: Column, first: dt.date | str | None = None, last: dt.date | str | None = None) -> Column:
    """A date moved into first to last; strings are ISO dates."""
    out = day.cast("date")
    if first is not None:
        out = F.greatest(out, F.lit(str(first)).cast("date"))
    return out if last is None else F.least(out, F.lit(str(last)).cast("date"))


def start_index(calendar: DataFrame, day: dt.date | str, least: int = 0) -> int:
    """The t of the calendar's first row on or after day, and at least `least`; the number of rows where all lie before."""
    row = calendar.agg(F.min(F.when(F.col("d") >= F.lit(str(day)).cast("date"), F.col("t"))).alias("t"), F.count(F.lit(1)).alias("n")).first()
    return max(least, int(row["n"] if row["t"] is None else row["t"]))


def number_in_name(path: Column) -> Column:
    """The last whole number in a file's name, as long; null without one. Orders origin-2 before origin-10."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).try_cast("long")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with every float rounded, however deep it lies in structs, arrays and map values."""

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.round(c, digits)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, t.valueType))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two tables that must have the same keys, each once; others are refused."""
    counts = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    wrong = counts.where("l <> 1 or r <> 1").first()
    if wrong:
        raise ValueError(f"{key} {wrong[key]} stands {wrong['l']} times on the left and {wrong['r']} times on the right")
    return left.join(right, key)


def ranking(df: DataFrame, name: str, value: str) -> DataFrame:
    """One row with the names in the order of falling values (ties by name), as a list."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))), lambda x: x["n"]).alias("ranking"))
