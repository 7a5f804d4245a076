"""Bootstraps and surrogates. Indices come from a linear congruential generator, so any engine draws the same ones.

The series is written once with its places and counted: one of at most MOST_SENT rows is broadcast to the draws, which then aren't
shuffled, and only sums by key and replicate are; a larger one meets them by a shuffle. The draws themselves are never broadcast,
though Spark takes them for as small as the series they are made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import DAYS_A_YEAR, ordered, ratio
from tapeworks.functions.written import written

#: Multiplier, increment and modulus of the generator.
A, C, M = 1103515245, 12345, 1 << 31
#: Rows of a series that is broadcast at most: some 20 MB of the driver's memory.
MOST_SENT = 200_000


def drawn(i: Column, n: Column) -> Column:
    """A place below n for the i-th draw."""
    return ((i * A + C) % M) % n


def _indexed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})


def _draws(own: DataFrame, keys: list[str], reps: int) -> DataFrame:
    """keys, i, n, rep: a row of each replicate for every row of own, a written series, which may be one file and is dealt out before."""
    rows = own.select(*keys, "i", "n").repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))


def _taken(draws: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """draws with the values of their places in own, a written series."""
    return draws.join(own.hint("broadcast" if own.count() <= MOST_SENT else "shuffle_hash"), [*keys, "i"])


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, order: list[str], reps: int) -> DataFrame:
    """keys, low and high 95 % bounds of the resampled mean, and the share of means of zero or less."""
    own = written(_indexed(rows, keys, order).select(*keys, F.col("i").cast("long"), F.col("n").cast("long"), F.col(value).alias("x")), "series")
    draws = _draws(own, keys, reps)
    draws = draws.select(*keys, "rep", drawn(F.col("rep") * F.col("n") + F.col("i"), F.col("n")).alias("i"))
    means = _taken(draws, own, keys).groupBy(*keys, "rep").agg(F.round(F.avg("x"), 9).alias("mean"))
    bounds = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(bounds.alias("b"), F.avg((F.col("mean") <= 0).cast("double")).alias("p_mean_le_zero")).select(*keys, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "p_mean_le_zero")


def block_bootstrap_sharpe(returns: DataFrame, keys: list[str], block: int, reps: int) -> DataFrame:
    """keys, low and high 95 % bounds of the annual Sharpe ratio over circular blocks of daily r."""
    own = written(_indexed(returns, keys, ["date"]).select(*keys, F.col("i").cast("long"), F.col("n").cast("long"), "r").where(F.col("n") >= 2 * block), "series")
    draws = _draws(own, keys, reps)
    blocks = F.ceil(F.col("n") / block)
    start = drawn(F.col("rep") * blocks + F.floor(F.col("i") / block), F.col("n"))
    draws = draws.select(*keys, "rep", ((start + F.col("i") % block) % F.col("n")).alias("i"))
    each = _taken(draws, own, keys).groupBy(*keys, "rep").agg(F.round(ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(float(DAYS_A_YEAR))), 9).alias("sharpe"))
    bounds = F.percentile("sharpe", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy(*keys).agg(bounds.alias("b"), F.avg(F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0)).alias("p_sharpe_le_zero")).select(*keys, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "p_sharpe_le_zero")


def kelly_bootstrap(trades: DataFrame, reps: int, f_max: float = 2.0, points: int = 21) -> DataFrame:
    """run, low, median and high bounds of the best fraction over resamples, and the share of resamples whose best is zero.

    A resample's mean log growth at every fraction of the grid is one sum over its draws: a column each, not a row each.
    """
    own = written(_indexed(trades, ["run"], ["open", "trade_id"]).select("run", F.col("i").cast("long"), F.col("n").cast("long"), (F.col("return_pct") / 100).alias("r")), "series")
    draws = _draws(own, ["run"], reps)
    draws = draws.select("run", "rep", drawn(F.col("rep") * F.col("n") + F.col("i"), F.col("n")).alias("i"))
    grid = [k * (f_max / (points - 1)) for k in range(points)]
    growth = [F.round(F.sum(F.when(1 + f * F.col("r") <= 0, -1e12).otherwise(F.log1p(f * F.col("r")))), 7) for f in grid]
    sums = _taken(draws, own.drop("n"), ["run"]).groupBy("run", "rep").agg(*[g.alias(f"g{k}") for k, g in enumerate(growth)])
    best = F.array_max(F.array(*[F.struct(F.col(f"g{k}").alias("g"), F.lit(-k).alias("k")) for k in range(points)]))  # ties to the smallest
    top = sums.select("run", (-best["k"] * F.lit(f_max / (points - 1))).alias("f"))
    b = F.percentile("f", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return top.groupBy("run").agg(b.alias("b"), F.avg((F.col("f") == 0).cast("double")).alias("share_zero")).select("run", F.col("b")[0].alias("p5"), F.col("b")[1].alias("p50"), F.col("b")[2].alias("p95"), "share_zero")


def block_shuffle(returns: DataFrame, keys: list[str], block: int) -> DataFrame:
    """keys, i, r, level: the series with its blocks in drawn order, and its running sum."""
    own = _indexed(returns, keys, ["date"]).withColumn("block", F.floor(F.col("i") / block))
    order = Window.partitionBy(*keys).orderBy(drawn(F.col("block"), F.lit(M)), "block", "i")
    own = own.withColumn("at", F.row_number().over(order) - 1)
    level = F.sum("r").over(ordered(keys, "at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.select(*keys, F.col("at").cast("long").alias("i"), "r", level.alias("level"))
