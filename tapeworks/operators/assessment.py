"""All that a study says of its runs, in one row each: trades, their uncertainty, daily values, growth and sizing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candles import simple_returns
from .records import daily_growth, kelly_report
from .resample import block_bootstrap_sharpe, bootstrap_mean
from .risk import beta_and_correlation, ratios, underwater
from .trades import concentration, power, trade_statistics

RUN = ["run"]


def assess_parts(trades: DataFrame, values: DataFrame, initial: float, years: float, reps: int = 10_000, sharpe_reps: int = 2_000, block: int = 20) -> dict[str, DataFrame]:
    """The parts of assess_runs(), a row a run each, by name; columns of a part that others have too begin with its name.

    trades: run, trade_id, open, close, return_pct, exit. values: run, date, strategy, buy_hold at the end of each day.
    """
    mine = simple_returns(values, RUN, "strategy").select("run", "date", "r")
    hold = simple_returns(values, RUN, "buy_hold").select("run", "date", F.col("r").alias("b"))
    both = mine.join(hold, ["run", "date"])
    parts = {
        "trades": trade_statistics(trades),
        "mean": bootstrap_mean(trades, RUN, "return_pct", ["open", "trade_id"], reps),
        "top": concentration(trades),
        "power": power(trades, years),
        "kelly": kelly_report(trades),
        "daily": ratios(mine, RUN),
        "hold": ratios(hold.withColumnRenamed("b", "r"), RUN),
        "market": beta_and_correlation(both, RUN),
        "sharpe": block_bootstrap_sharpe(mine, RUN, block, sharpe_reps),
        "risk": underwater(values, RUN, "strategy", initial),
        "growth": daily_growth(values, RUN, "strategy"),
    }
    return {name: part.select("run", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != "run"]) for name, part in parts.items()}


def assess_runs(parts: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """runs (run) with all parts; what a run has no trades or days for is null."""
    return reduce(lambda a, b: a.join(b, "run", "left"), parts.values(), runs)
