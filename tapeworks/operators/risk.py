"""Risk of value series: drawdown, underwater time, periods, Sharpe and relatives. Keys name the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import DAYS_A_YEAR, islands, ordered, ratio, so_far


def drawdowns(values: DataFrame, keys: list[str], value: str, initial: float | None = None) -> DataFrame:
    """The rows with peak (initial counts as one) and drawdown_pct."""
    peak = F.max(value).over(so_far(keys))
    peak = peak if initial is None else F.greatest(peak, F.lit(float(initial)))
    return values.withColumn("peak", peak).withColumn("drawdown_pct", 100 * (F.col("peak") - F.col(value)) / F.col("peak"))


def daily_marks(values: DataFrame, keys: list[str], value: str, at: str = "date") -> DataFrame:
    """keys, day, value: the last value of each day."""
    return values.groupBy(*keys, F.to_date(at).alias("day")).agg(F.max_by(value, at).alias(value))


def underwater(values: DataFrame, keys: list[str], value: str, initial: float, start: str | None = None) -> DataFrame:
    """Per series: return, drawdowns, and calendar days below the last peak; equality ends an episode.

    initial is the first peak, at the day in `start` or else the series' first day; a mark's boundary is the day after it.
    """
    first = F.min("date" if start is None else start).over(Window.partitionBy(*keys))
    d = drawdowns(values, keys, value, initial).withColumns({"first": first, "boundary": F.date_add("date", 1)})
    at_peak = F.last(F.when(F.col(value) >= F.col("peak"), F.col("boundary")), ignorenulls=True).over(so_far(keys))
    d = d.withColumn("days", F.when(F.col(value) < F.col("peak"), F.datediff("boundary", F.coalesce(at_peak, "first"))).otherwise(0))
    return d.groupBy(*keys).agg(
        (100 * (F.max_by(value, "date") / initial - 1)).alias("return_pct"),
        F.max("drawdown_pct").alias("max_drawdown_pct"),
        F.max_by("drawdown_pct", "date").alias("current_drawdown_pct"),
        F.max("days").cast("long").alias("longest_underwater_days"),
        F.max_by("days", "date").cast("long").alias("current_underwater_days"),
    )


def longest_run(rows: DataFrame, keys: list[str], flag, order: str, out: str) -> DataFrame:
    """keys, out: the longest run of consecutive rows for which flag holds."""
    marked = rows.withColumn("flag", flag).withColumn("run_no", islands(F.col("flag"), keys, order))
    runs = marked.groupBy(*keys, "run_no").agg(F.count_if("flag").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias(out))


def longest_drawdown_marks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return longest_run(drawdowns(values, keys, value), keys, F.col(value) < F.col("peak"), "date", "longest_drawdown_marks")


def yearly_returns(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, year, strategy_pct, buy_hold_pct, marks: on the previous year's last mark, in the first year on its first."""
    y = values.groupBy(*keys, F.year("date").alias("year")).agg(*[f(c, "date").alias(f"{n}_{c}") for c in ("strategy", "buy_hold") for n, f in (("first", F.min_by), ("last", F.max_by))], F.count("*").alias("marks"))
    base = {c: F.coalesce(F.lag(f"last_{c}").over(ordered(keys, "year")), F.col(f"first_{c}")) for c in ("strategy", "buy_hold")}
    return y.select(*keys, F.col("year").cast("long").alias("year"), *[(100 * (F.col(f"last_{c}") / b - 1)).alias(f"{c}_pct") for c, b in base.items()], "marks")


def monthly_returns(values: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, month, from_boundary, through, partial_month, incomplete, marks and the two returns with their difference."""
    month = F.trunc("date", "month")
    m = values.groupBy(*keys, month.alias("month")).agg(F.max_by("strategy", "date").alias("s"), F.max_by("buy_hold", "date").alias("b"), F.max("date").alias("through"), F.count("*").alias("marks"), F.min("date").alias("first"))
    w = ordered(keys, "month")
    m = m.withColumns({"next_day": F.date_add("through", 1), "s0": F.lag("s", 1, float(initial)).over(w), "b0": F.lag("b", 1, float(initial)).over(w)})
    m = m.withColumn("from_boundary", F.coalesce(F.lag("next_day").over(w), F.col("first")))
    m = m.withColumns({"strategy_pct": 100 * (F.col("s") / F.col("s0") - 1), "buy_hold_pct": 100 * (F.col("b") / F.col("b0") - 1)})
    return m.select(
        *keys, "month", "from_boundary", "through",
        ((F.col("from_boundary") != F.col("month")) | (F.dayofmonth("next_day") != 1)).alias("partial_month"),
        (F.col("marks") != F.datediff("next_day", "from_boundary")).alias("incomplete"),
        "marks", "strategy_pct", "buy_hold_pct", (F.col("strategy_pct") - F.col("buy_hold_pct")).alias("excess_pp"),
    )


def moments(returns: DataFrame, keys: list[str], per_year: float) -> DataFrame:
    """Per series of r: count, mean, population deviation, skewness and excess kurtosis, annualised volatility."""
    return returns.groupBy(*keys).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"), (F.stddev_pop("r") * F.sqrt(F.lit(float(per_year))) * 100).alias("volatility_pct"))


def ratios(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Per series of daily r: annualised volatility, Sharpe and Sortino; undefined ones are null."""
    year = F.sqrt(F.lit(float(DAYS_A_YEAR)))
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2.0))))
    return returns.groupBy(*keys).agg((F.stddev_samp("r") * year * 100).alias("volatility_pct"), (ratio(F.avg("r"), F.stddev_samp("r")) * year).alias("sharpe"), (ratio(F.avg("r"), down) * year).alias("sortino"))


def beta_and_correlation(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Per series of r and benchmark b: beta and correlation; undefined ones are null."""
    return returns.groupBy(*keys).agg(ratio(F.covar_samp("r", "b"), F.var_samp("b")).alias("beta"), ratio(F.covar_pop("r", "b"), F.stddev_pop("r") * F.stddev_pop("b")).alias("correlation"))


def buy_and_hold(candles: DataFrame, fee: float) -> DataFrame:
    """Per pair: gross and net return, drawdown and growth a year of holding from the first close to the last."""
    d = drawdowns(candles, ["pair"], "close")
    gross = F.max_by("close", "date") / F.min_by("close", "date")
    years = (F.max(F.unix_seconds(F.col("date").cast("timestamp"))) - F.min(F.unix_seconds(F.col("date").cast("timestamp")))) / (86400 * 365.25)
    net = gross * (1 - fee) * (1 - fee)
    return d.groupBy("pair").agg(F.count("*").alias("candles"), (100 * (gross - 1)).alias("gross_pct"), (100 * (net - 1)).alias("net_pct"), F.when(years > 0, 100 * (F.pow(net, 1 / years) - 1)).alias("cagr_pct"), F.max("drawdown_pct").alias("max_drawdown_pct"))


def forward_benchmark(candles: DataFrame, notional: float, fee: float) -> DataFrame:
    """Per pair: what notional, spent on the first open with its fee, is worth at the last close after its fee."""
    first = F.first("open").over(so_far(["pair"]))
    worth = candles.withColumn("worth", notional / (1 + fee) / first * F.col("close") * (1 - fee))
    d = drawdowns(worth, ["pair"], "worth", notional)
    return d.groupBy("pair").agg(F.max_by("worth", "date").alias("final"), (100 * (F.max_by("worth", "date") / notional - 1)).alias("net_pct"), F.max("drawdown_pct").alias("max_drawdown_pct"))
