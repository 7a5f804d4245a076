"""Column expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAYS_A_YEAR = 365


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and NaN or infinite ones null, for results that are compared."""
    inf = F.lit(float("inf"))
    return df.select(*[F.when(F.isnan(c) | (F.abs(c) == inf), None).otherwise(F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ordered(keys: list[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def so_far(keys: list[str], order: str = "date") -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full(value: Column, window: WindowSpec, n: int) -> Column:
    """value, but null unless the frame of `window` has n rows."""
    return F.when(F.count(F.lit(1)).over(window) == n, value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def hour_of(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc("hour", c.cast("timestamp")).cast("timestamp_ntz")


def differs(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether a and b differ by more than a tolerance."""
    return F.abs(a - b) > absolute + relative * F.greatest(F.abs(a), F.abs(b))


def islands(flag: Column, keys: list[str], order: str) -> Column:
    """A number for each run of rows since flag was last false; rows with flag true in one run share it."""
    return F.sum(F.when(flag, 0).otherwise(1)).over(so_far(keys, order))


def timeframe(text: str) -> int:
    """Microseconds of a timeframe such as 15m, 4h or 1d."""
    units = {"m": 60, "h": 3600, "d": 86400}
    if len(text) < 2 or text[-1] not in units or not text[:-1].isdigit() or int(text[:-1]) == 0:
        raise ValueError(f"unknown timeframe {text!r}")
    return int(text[:-1]) * units[text[-1]] * 1_000_000


def utc(text: Column, strict: bool = False) -> Column:
    """The UTC time of ISO text; without a zone it is UTC, or null if strict. Null where it is no time."""
    zoned = F.regexp_like(F.trim(text), F.lit(r"([Zz]|[+-]\d{2}:?\d{2})$"))
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(zoned, at) if strict else F.when(zoned, at).otherwise(F.trim(text).try_cast("timestamp_ntz"))


def stacked(by: list[str], *parts: DataFrame) -> DataFrame:
    """The rows of all parts, dealt by keys for the window or aggregate that follows.

    That deals them anyway. Said outright, the plan doesn't rest on parts that are dealt by the same keys already, which adaptive
    plans may have changed by the time a join counts their partitions.
    """
    return reduce(DataFrame.unionByName, parts).repartition(*by)
