"""Statistics of closed trades (run, trade_id, open, close, return_pct, exit), growth and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import micros, ordered, ratio

from .risk import drawdowns, underwater
from .running import running_sum

RUN = ["run"]
HOUR = 3_600_000_000.0


def trade_statistics(trades: DataFrame) -> DataFrame:
    """One row a run: counts, means, t statistic, profit factor, payoff, the two best, losing streak, holding days, exits."""
    r = F.col("return_pct")
    t = trades.withColumn("hours", (micros("close") - micros("open")) / HOUR)
    wins, losses = F.when(r > 0, r), F.when(r <= 0, r)
    stats = t.groupBy("run").agg(
        F.count("*").alias("count"),
        F.count_if(r > 0).alias("winners"),
        (100 * F.count_if(r > 0) / F.count("*")).alias("win_rate_pct"),
        F.avg(r).alias("mean_pct"),
        F.stddev_samp(r).alias("sd_pct"),
        ratio(F.avg(r), F.stddev_samp(r) / F.sqrt(F.count("*"))).alias("t_stat"),
        F.sum(r).alias("sum_pct"),
        F.when(F.sum(losses) < 0, F.sum(wins) / -F.sum(losses)).alias("profit_factor"),
        F.avg(wins).alias("mean_win_pct"),
        F.avg(losses).alias("mean_loss_pct"),
        F.when(F.avg(losses) < 0, F.avg(wins) / -F.avg(losses)).alias("payoff_ratio"),
        (F.percentile("hours", 0.5) / 24).alias("median_holding_days"),
        (F.avg("hours") / 24).alias("mean_holding_days"),
        *[F.count_if(F.col("exit") == e).alias(f"exit_{e}") for e in ("exit_signal", "force_exit", "stop_loss")],
    )
    two = two_best(trades).groupBy("run").agg(F.sum(r).alias("top2_pp"))
    both = stats.join(two, "run").withColumn("rest_pp", F.when(F.col("count") > 2, F.col("sum_pct") - F.col("top2_pp")).otherwise(0.0))
    return both.join(losing_streak(trades), "run")


def two_best(trades: DataFrame) -> DataFrame:
    """The two trades of each run with the highest returns, ties by trade_id: first of every slice of a run, then of those."""
    order = [F.desc("return_pct"), F.col("trade_id")]
    sliced = trades.select("run", "trade_id", "return_pct", F.pmod(F.xxhash64("trade_id"), F.lit(64)).alias("slice"))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("run", "slice").orderBy(*order))).where("rank <= 2")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(*order))).where("rank <= 2").drop("slice", "rank")


def losing_streak(trades: DataFrame) -> DataFrame:
    """run, longest_losing_streak: by opening; a trade of zero is a loss. Gains are counted in slices of a day, so no window holds a run;
    losses with equally many gains before them are a streak."""
    won = trades.withColumns({"__won": F.when(F.col("return_pct") <= 0, 0).otherwise(1).cast("long"), "__day": F.to_date("open")})
    streaks = running_sum(won.select("run", "open", "trade_id", "__day", "__won"), RUN, "__day", ["open", "trade_id"], "__won", "__gains")
    return streaks.groupBy("run", "__gains").agg(F.count_if(F.col("__won") == 0).alias("n")).groupBy("run").agg(F.max("n").alias("longest_losing_streak"))


def duration_exposure(trades: DataFrame, days: DataFrame) -> DataFrame:
    """run, exposure_pct: minutes inside trades over those of the run's days (run, days); trades at the same time count each, and a
    run without days has none."""
    minutes = F.sum((micros("close") - micros("open")) / 60e6)
    x = days.join(trades.groupBy("run").agg(minutes.alias("minutes")), "run", "left")
    return x.select("run", F.when(F.col("days") > 0, 100 * F.coalesce("minutes", F.lit(0.0)) / (F.col("days") * 1440)).otherwise(0.0).alias("exposure_pct"))


def exit_histogram(trades: DataFrame) -> DataFrame:
    return trades.groupBy("run", "exit").agg(F.count("*").alias("n"))


def exposure(trades: DataFrame, start: Column, end: Column) -> DataFrame:
    """run, exposure_pct: share of [start, end) inside a trade."""
    held = F.greatest(F.lit(0), F.least(micros("close"), micros(end)) - F.greatest(micros("open"), micros(start)))
    return trades.groupBy("run").agg((100 * F.sum(held) / (micros(end) - micros(start))).alias("exposure_pct"))


def concentration(trades: DataFrame) -> DataFrame:
    """Per run: the sum, what the two best winners add, and the rest."""
    two = two_best(trades).where("return_pct > 0").groupBy("run").agg(F.count("*").alias("top_winners"), F.sum("return_pct").alias("top_two_pp"))
    t = trades.groupBy("run").agg(F.count("*").alias("trades"), F.sum("return_pct").alias("sum_pp")).join(two, "run", "left")
    top = F.coalesce("top_two_pp", F.lit(0.0))
    return t.select("run", "trades", F.coalesce("top_winners", F.lit(0)).alias("top_winners"), "sum_pp", top.alias("top_two_pp"), (F.col("sum_pp") - top).alias("without_top_two_pp"))


def power(trades: DataFrame, years: float, t_target: float = 2.0) -> DataFrame:
    """Per run: trades and years until a mean of this size would reach t_target; null where it never does."""
    s = trades.groupBy("run").agg(F.count("*").alias("n"), F.avg("return_pct").alias("mean"), F.stddev_samp("return_pct").alias("sd"))
    needed = F.when((F.col("mean") > 0) & (F.col("sd") > 0), F.ceil(F.pow(t_target * F.col("sd") / F.col("mean"), F.lit(2.0))))
    per_year = F.col("n") / F.lit(float(years))
    return s.select("run", needed.alias("trades_needed"), per_year.alias("trades_per_year"), ratio(needed, per_year).alias("years_needed"))


def trade_growth(trades: DataFrame) -> DataFrame:
    """Per run: mean, mean log growth, log of the mean, their gap and half the variance; a total loss leaves no growth."""
    r = F.col("return_pct") / 100
    ruin = F.bool_or(r <= -1)
    log = F.when(~ruin, F.avg(F.when(r > -1, F.log1p(r))))
    # returns have four decimals: summed as integers, their mean doesn't depend on the order of rows
    mean = F.sum(F.round(F.col("return_pct") * 10000).cast("long")) / 1e6 / F.count("*")
    g = trades.groupBy("run").agg(mean.alias("mean"), log.alias("mean_log"), (F.var_pop(r) / 2).alias("volatility_drag"))
    return g.select("run", "mean", "mean_log", F.log1p("mean").alias("log_mean"), (F.log1p("mean") - F.col("mean_log")).alias("gap"), "volatility_drag")


def kelly(trades: DataFrame, f_max: float = 2.0, points: int = 41) -> DataFrame:
    """Per run: the fraction of the grid with the highest mean ln(1 + f r), ties to the smallest; ruin counts as -1e12. Equal returns are taken together."""
    same = trades.groupBy("run", (F.col("return_pct") / 100).alias("r")).agg(F.count("*").alias("c"))
    g = same.select("run", "r", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("f", F.col("k") * F.lit(f_max / (points - 1)))
    growth = F.when(1 + F.col("f") * F.col("r") <= 0, -1e12).otherwise(F.log1p(F.col("f") * F.col("r")))
    mean = g.groupBy("run", "k", "f").agg(F.round(F.sum(F.col("c") * growth) / F.sum("c"), 9).alias("growth"))
    best = F.max(F.struct("growth", (-F.col("k")).alias("k"), "f")).alias("best")
    return mean.groupBy("run").agg(best).select("run", F.col("best.f").alias("kelly_fraction"), F.col("best.growth").alias("growth"))


def frontier(values: DataFrame, keys: list[str], fractions: list[float], initial: float) -> DataFrame:
    """Per series and fraction: wealth compounded by 1 + f * change / initial, its growth and drawdown."""
    step = F.coalesce((F.col("strategy") - F.lag("strategy").over(ordered(keys))) / initial, F.lit(0.0))
    v = values.withColumn("step", step)  # before rows are repeated
    v = v.select(*keys, "date", "step", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("f"))
    each = [*keys, "f"]
    so_far = ordered(each).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("wealth", F.exp(F.sum(F.log1p(F.col("f") * F.col("step"))).over(so_far)))
    d = drawdowns(v, each, "wealth", 1.0)
    return d.groupBy(*each).agg(F.max_by("wealth", "date").alias("terminal"), F.max("drawdown_pct").alias("max_drawdown_pct"), (F.ln(F.max_by("wealth", "date")) / F.count("*") * 365).alias("growth_a_year"))


def constant_exposure(values: DataFrame, keys: list[str], fraction: float, fee: float, initial: float) -> DataFrame:
    """keys, date, worth: a constant fraction of the benchmark, paying a fee on the way in and on the last day out."""
    r = F.coalesce(F.col("buy_hold") / F.lag("buy_hold").over(ordered(keys)) - 1, F.lit(0.0))
    so_far = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = values.withColumn("r", r).withColumn("wealth", initial * (1 - fraction * fee) * F.exp(F.sum(F.log1p(fraction * F.col("r"))).over(so_far)))
    last = F.lead("date").over(ordered(keys)).isNull()
    return v.select(*keys, "date", (F.col("wealth") * F.when(last, 1 - fraction * fee).otherwise(1.0)).alias("worth"))


def sleeves(values: DataFrame, keys: list[str], fractions: list[float], initial: float, monthly_cost: float) -> DataFrame:
    """Per series and fraction: risk of the scaled curve, cash return a year, and the capital at which costs break even."""
    v = values.select(*keys, "date", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("sleeve"), "strategy").withColumn("worth", initial + F.col("sleeve") * (F.col("strategy") - initial))
    risk = underwater(v, [*keys, "sleeve"], "worth", initial)
    span = values.groupBy(*keys).agg((F.datediff(F.max("date"), F.min("date")) / 365).alias("years"))
    rate = F.col("return_pct") / 100 / F.col("years")
    cost = monthly_cost * 12
    return risk.join(span, keys).select(*keys, "sleeve", "return_pct", "max_drawdown_pct", "longest_underwater_days", (100 * rate).alias("cash_pct_a_year"), F.when(rate > 0, cost / rate).alias("break_even_capital"))
