"""Trades that channel signals lead to: one position a pair, a stop, a cooldown, and a guard after repeated stops.

Signals come from windows; the path-dependent part is a small kernel over one pair's candles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.columns import micros, so_far, stacked

from .candles import HOUR, ChannelRules, signals
from .risk import drawdowns


@dataclass(frozen=True)
class Rules:
    """Durations are in candles. A lock ends on the candle after its end, as ends are rounded up to the next one."""

    channels: ChannelRules = ChannelRules()
    stoploss: float = -0.01
    guard_lookback: int = 48
    guard_limit: int = 2
    guard_duration: int = 12


TRADES = "open_date timestamp_ntz, close_date timestamp_ntz, open_rate double, close_rate double, amount double, profit_ratio double, profit_abs double, exit_reason string"


def positions(at: np.ndarray, open_: np.ndarray, low: np.ndarray, close: np.ndarray, enter: np.ndarray, leave: np.ndarray, rules: Rules, fee: float, step: int) -> list[tuple]:
    """(entry time, exit time, entry rate, exit rate, profit ratio, reason) of each trade; times are integers."""
    n = len(at)
    ready, leaving = np.flatnonzero(enter), np.flatnonzero(leave)
    out: list[tuple] = []
    stops: list[int] = []
    row = 1
    while row < n:
        k = np.searchsorted(ready, row - 1)
        if k == len(ready) or ready[k] + 1 >= n:
            break
        entry = int(ready[k]) + 1
        rate, level = open_[entry], open_[entry] * (1 + rules.stoploss)
        k = np.searchsorted(leaving, entry)
        last = int(leaving[k]) + 1 if k < len(leaving) and leaving[k] + 1 < n else n
        hit = np.flatnonzero(low[entry:last] <= level)  # the stop can only come before the candle that an exit signal opens
        if len(hit):
            end = entry + int(hit[0])
            when, price, reason = int(at[end]), min(open_[end], level), "stop_loss"
        elif last < n:
            end, when, price, reason = last, int(at[last]), open_[last], "exit_signal"
        else:
            end, when, price, reason = n - 1, int(at[n - 1]) + step, close[n - 1], "force_exit"
        profit = price * (1 - fee) / (rate * (1 + fee)) - 1

        def lock(candles: int, when: int = when) -> int:
            return (when + candles * step) // step * step + step

        free = lock(1)
        if reason == "stop_loss":
            stops = [t for t in [*stops, when] if t > when - rules.guard_lookback * step]
            if len(stops) >= rules.guard_limit:
                free = max(free, lock(rules.guard_duration))
        out.append((int(at[entry]), when, rate, price, profit, reason))
        row = max(end + 1, int(np.searchsorted(at, free)))
    return out


def simulate(candles: DataFrame, keys: list[str], rules: Rules = Rules(), fee: float = 0.001, notional: float = 1000.0, step: int = HOUR) -> DataFrame:
    """keys and the columns of TRADES. candles: pair, date, open, high, low, close (keys include pair)."""
    s = signals(candles, rules.channels).withColumn("at", micros("date"))

    def kernel(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        cols = [own[c].to_numpy() for c in ("at", "open", "low", "close", "enter", "exit")]
        rows = positions(*cols, rules, fee, step)
        head = {k: own[k].iloc[0] for k in keys}
        made = pd.DataFrame(rows, columns=["open_date", "close_date", "open_rate", "close_rate", "profit_ratio", "exit_reason"])
        made["amount"] = notional / made["open_rate"].astype(float)
        made["profit_abs"] = made["amount"] * (made["close_rate"].astype(float) * (1 - fee) - made["open_rate"].astype(float) * (1 + fee))
        for c in ("open_date", "close_date"):
            made[c] = pd.to_datetime(made[c].astype("int64"), unit="us")
        return made.assign(**head)[[*keys, *(c.split()[0] for c in TRADES.split(", "))]]

    types = dict(candles.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + TRADES
    return s.select(*keys, "at", "open", "low", "close", "enter", "exit").groupBy(*keys).applyInPandas(kernel, schema)


def mark_to_market(trades: DataFrame, candles: DataFrame, keys: list[str], wallet: float, fee: float) -> DataFrame:
    """keys, date, equity at each candle's close: realised profit, and the open trade at its close with its exit fee.

    Closes, openings and marks are one ordered stream of events, so a window takes the place of a range join.
    """
    none = F.lit(None).cast("double")
    closes = trades.select(*keys, F.col("close_date").alias("date"), F.lit(0).alias("kind"), F.col("profit_abs").alias("profit"), none.alias("rate"), none.alias("amount"), F.lit(None).cast("timestamp_ntz").alias("until"), none.alias("close"))
    opens = trades.select(*keys, F.col("open_date").alias("date"), F.lit(1).alias("kind"), none.alias("profit"), F.col("open_rate").alias("rate"), "amount", F.col("close_date").alias("until"), none.alias("close"))
    marks = candles.select(*keys, "date", F.lit(2).alias("kind"), none.alias("profit"), none.alias("rate"), none.alias("amount"), F.lit(None).cast("timestamp_ntz").alias("until"), "close")
    w = so_far(keys, "kind_at")
    e = stacked(keys, closes, opens, marks).withColumn("kind_at", F.struct("date", "kind"))
    e = e.withColumns({"realised": F.coalesce(F.sum("profit").over(w), F.lit(0.0)), "held": F.last(F.when(F.col("kind") == 1, F.struct("rate", "amount", "until")), ignorenulls=True).over(w)})
    worth = F.when(F.col("date") < F.col("held.until"), F.col("held.amount") * (F.col("close") * (1 - fee) - F.col("held.rate") * (1 + fee)))
    return e.where("kind = 2").select(*keys, "date", (wallet + F.col("realised") + F.coalesce(worth, F.lit(0.0))).alias("equity"))


def summary(trades: DataFrame, equity: DataFrame, keys: list[str], notional: float) -> DataFrame:
    """keys, net_return_pct, mtm_max_drawdown_pct, trades, stop_exits."""
    d = drawdowns(equity, keys, "equity", notional).groupBy(*keys).agg((100 * (F.max_by("equity", "date") / notional - 1)).alias("net_return_pct"), F.max("drawdown_pct").alias("mtm_max_drawdown_pct"))
    t = trades.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(F.col("exit_reason") == "stop_loss").alias("stop_exits"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("trades", "stop_exits")}
    return d.join(t, keys, "left").select(*keys, "net_return_pct", "mtm_max_drawdown_pct", *zero.values())
