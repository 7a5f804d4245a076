"""Protection after losses: locks that a fall of summed profits within a strict lookback sets off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import micros, stacked


def recent_falls(trades: DataFrame, keys: list[str], at: str, order: list[str], value: str, lookback: int) -> DataFrame:
    """trades with in_window and fall: how many trades closed within `lookback` microseconds before a row's time, itself included
    and those exactly that long ago not, and the largest fall of their summed values from a running peak that starts at zero.

    Time is cut into buckets of the lookback, so a window is the end of one bucket and the beginning of the next. Falls, peaks and
    troughs run forward from each bucket's beginning and backward from its end, and a window joins two of them: its fall is the
    larger of both parts' or from the first one's peak to the second one's trough. No window holds more than a bucket.
    """
    t = trades.withColumn("__t", micros(at)).withColumn("__bucket", F.floor(F.col("__t") / lookback))
    ordered = Window.partitionBy(*keys, "__bucket").orderBy("__t", *order)
    so_far, rest = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0.0)
    t = t.withColumns({"__c": F.sum(value).over(so_far), "__k": F.row_number().over(ordered), "__n": F.count("*").over(Window.partitionBy(*keys, "__bucket"))})
    t = t.withColumns({"__base": F.col("__c") - F.col(value), "__peak": F.greatest(F.max("__c").over(so_far), zero), "__trough": F.min("__c").over(rest)})
    t = t.withColumns({
        "__fall": F.max(F.col("__peak") - F.col("__c")).over(so_far), "__least": F.least(F.min("__c").over(so_far), zero), "__total": F.last("__c").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "__end_fall": F.greatest(F.max(F.col("__base") - F.col("__trough")).over(rest), zero), "__end_peak": F.max(F.greatest("__base", "__c")).over(rest), "__end_count": F.col("__n") - F.col("__k") + 1,
    })
    # the first row of the bucket before that is later than the row's time less the lookback: rows ask, in the order of time from the end
    ask = t.select(*keys, *order, (F.col("__bucket") - 1).alias("__bucket"), (F.col("__t") - lookback).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("struct<fall:double,peak:double,n:bigint>").alias("__end"))
    end = F.struct((F.col("__end_fall")).alias("fall"), (F.col("__end_peak") - F.col("__total")).alias("peak"), F.col("__end_count").cast("long").alias("n"))
    have = t.select(*keys, *order, "__bucket", F.col("__t").alias("__at"), F.lit(1).alias("__kind"), end.alias("__end"))
    back = Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__at"), "__kind", *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = stacked([*keys, "__bucket"], ask, have).withColumn("__end", F.when(F.col("__kind") == 0, F.last("__end", ignorenulls=True).over(back))).where("__kind = 0").select(*keys, *order, "__end")
    x = t.join(found, [*keys, *order], "left")
    across = F.coalesce(F.col("__end.peak") - F.col("__least"), zero)
    return x.select(*trades.columns, (F.col("__k") + F.coalesce("__end.n", F.lit(0))).cast("long").alias("in_window"), F.greatest("__fall", F.coalesce("__end.fall", zero), across).alias("fall"))


def drawdown_locks(trades: DataFrame, keys: list[str], order: list[str], step: int, lookback: int = 540, limit: float = 0.25, duration: int = 180, least: int = 1) -> DataFrame:
    """recent_falls() of trades (keys, order, close, ratio; order is unique) and lock_end: after a fall above `limit` over at least
    `least` trades, the first boundary of a step after `duration` steps from the close; null without a lock."""
    f = recent_falls(trades, keys, "close", order, "ratio", lookback * step)
    until = (F.floor((micros("close") + duration * step) / step) + 1) * step
    locked = (F.col("fall") > limit) & (F.col("in_window") >= least)
    return f.withColumn("lock_end", F.when(locked, F.timestamp_micros(until).cast("timestamp_ntz")))
