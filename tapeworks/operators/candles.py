"""Candles: contract checks, returns, wicks, channels, signals, volatility. All windows are by pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import differs, full, micros, ordered, so_far, stacked

HOUR = 3_600_000_000
PAIR = ["pair"]


@dataclass(frozen=True)
class ChannelRules:
    """Lengths of the entry and exit channels in candles."""

    entry: int = 24
    exit: int = 12


def candle_violations(candles: DataFrame, step: int = HOUR) -> DataFrame:
    """Per pair: candles, gaps, and how many break each rule of the candle contract."""
    last = F.lag(micros("date")).over(ordered(PAIR))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    c = candles.withColumn("gap", micros("date") - last)
    bad_price = F.coalesce(F.least(*prices) <= 0, F.lit(True)) | F.greatest(*[F.isnan(p) | (p == float("inf")) for p in prices])
    return c.groupBy("pair").agg(
        F.count("*").alias("candles"),
        F.count_if(F.col("gap") != step).alias("gaps"),
        F.count_if(F.col("gap") <= 0).alias("not_increasing"),
        F.count_if(micros("date") % step != 0).alias("off_grid"),
        F.count_if(bad_price).alias("bad_price"),
        F.count_if(F.coalesce((F.col("volume") < 0) | F.isnan("volume") | (F.col("volume") == float("inf")), F.lit(True))).alias("bad_volume"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_too_low"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_too_high"),
    )


def assert_candles(candles: DataFrame, step: int = HOUR, gaps_allowed: bool = False) -> DataFrame:
    """candles, or an error that names the first pair that breaks the contract."""
    checks = ["not_increasing", "off_grid", "bad_price", "bad_volume", "high_too_low", "low_too_high", *([] if gaps_allowed else ["gaps"])]
    bad = candle_violations(candles, step).where(" or ".join(f"{c} > 0" for c in checks)).first()
    if bad is not None:
        raise ValueError(f"candles of {bad['pair']}: " + ", ".join(f"{c}={bad[c]}" for c in checks if bad[c]))
    return candles


def require_fresh(candles: DataFrame, now: Column, step: int = HOUR) -> DataFrame:
    """pair, fresh: whether the last candle ended at most one step before now."""
    return candles.groupBy("pair").agg((micros(now) - (F.max(micros("date")) + step) <= step).alias("fresh"))


def closed(candles: DataFrame, now: Column, step: int = HOUR) -> DataFrame:
    """Candles that have ended by now."""
    return candles.where(micros("date") + step <= micros(now))


def settled(candles: DataFrame, now: Column, step: int = HOUR) -> DataFrame:
    """Candles that ended at least one step ago, which an archive may take as final."""
    return candles.where(micros("date") + 2 * step <= micros(now))


def log_returns_from_open(candles: DataFrame) -> DataFrame:
    """pair, date, r: log return on the previous close, the first on its own open."""
    return candles.select("pair", "date", F.ln(F.col("close") / F.coalesce(F.lag("close").over(ordered(PAIR)), F.col("open"))).alias("r"))


def log_returns(candles: DataFrame) -> DataFrame:
    """pair, date, r: log return on the previous close, without the first candle."""
    r = candles.select("pair", "date", (F.ln("close") - F.ln(F.lag("close").over(ordered(PAIR)))).alias("r"))
    return r.where(F.col("r").isNotNull())


def simple_returns(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows with r, their change on the previous mark, without each group's first."""
    return values.withColumn("r", F.col(value) / F.lag(value).over(ordered(keys)) - 1).where(F.col("r").isNotNull())


def wick_ratios(candles: DataFrame) -> DataFrame:
    body_high, body_low = F.greatest("open", "close"), F.least("open", "close")
    return candles.select("pair", "date", (F.col("high") / body_high - 1).alias("upper"), (1 - F.col("low") / body_low).alias("lower"))


def channels(candles: DataFrame, rules: ChannelRules = ChannelRules()) -> DataFrame:
    """candles with entry_high and exit_low over the candles before; null until the channel is full."""
    before, out = ordered(PAIR).rowsBetween(-rules.entry, -1), ordered(PAIR).rowsBetween(-rules.exit, -1)
    return candles.withColumns({"entry_high": full(F.max("high").over(before), before, rules.entry), "exit_low": full(F.min("low").over(out), out, rules.exit)})


def signals(candles: DataFrame, rules: ChannelRules = ChannelRules()) -> DataFrame:
    """channels() with enter and exit; an undefined channel never signals."""
    enter, leave = F.col("close") > F.col("entry_high"), F.col("close") < F.col("exit_low")
    return channels(candles, rules).withColumns({"enter": F.coalesce(enter, F.lit(False)), "exit": F.coalesce(leave, F.lit(False))})


def realized_volatility(candles: DataFrame, n: int = 24, per_year: float = 24 * 365) -> DataFrame:
    """pair, date, sigma: annualised deviation of the last n log returns; null until there are n."""
    r = candles.withColumn("r", F.ln(F.col("close") / F.lag("close").over(ordered(PAIR))))
    last = ordered(PAIR).rowsBetween(-(n - 1), 0)
    sigma = F.when(F.count("r").over(last) == n, F.stddev_samp("r").over(last) * F.sqrt(F.lit(float(per_year))))
    return r.select("pair", "date", sigma.alias("sigma"))


def target_fraction(sigma: Column, target: float = 0.40, floor: float = 0.25) -> Column:
    """Stake fraction for a volatility target; undefined or flat volatility takes the floor."""
    return F.when(sigma.isNull() | F.isnan(sigma) | (sigma <= 0), floor).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), target / sigma)))


def archive_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both; of equal keys the archived row stays. check_immutable() must find nothing first."""
    both = stacked(keys, old.withColumn("__new", F.lit(0)), new.withColumn("__new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__new"))
    return both.withColumn("__first", first).where("__first = 1").drop("__new", "__first")


def check_immutable(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The rows of new that contradict an archived row beyond a relative 1e-10."""
    was = old.select(*keys, *[F.col(v).alias(f"was_{v}") for v in values])
    off = [differs(F.col(v), F.col(f"was_{v}"), 1e-12, 1e-10) for v in values]
    return new.join(was, keys).where(F.greatest(*off)) if len(off) > 1 else new.join(was, keys).where(off[0])
