"""Ledgers of trials: the best of many is judged against what as many without skill would show.

A trial is a row (ledger, id, kind, counted, period, sharpe: annual or null). recorded Sharpe ratios of different periods aren't
comparable; on_common_part() works them out anew where all counted trials of a ledger overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.columns import DAYS_A_YEAR, ratio

from .normal import deflated_sharpe, normal_quantile

EULER = 0.5772156649015329
ROOT = math.sqrt(DAYS_A_YEAR)
#: Why there is no adjustment for the number of trials, in order.
MISSING, PERIODS, FEW = "a counted trial has no Sharpe ratio", "counted trials have different periods", "fewer than two counted trials have a Sharpe ratio"
NO_COMMON = "counted trials have no period in common"


def sharpes(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sharpe: annual, null for fewer than two returns or none that differ."""
    sd = F.stddev_samp("r")
    return returns.groupBy(*keys).agg(F.when((F.count("r") > 1) & (F.min("r") < F.max("r")), ratio(F.avg("r"), sd) * ROOT).alias("sharpe"))


def on_common_part(trials: DataFrame, returns: DataFrame) -> DataFrame:
    """trials (ledger, id, kind, counted, start, end) with period and sharpe where all counted trials of their ledger overlap
    (period null: nowhere). returns: ledger, id, date, r; end is exclusive."""
    common = trials.where("counted").groupBy("ledger").agg(F.max("start").alias("low"), F.min("end").alias("high"))
    placed = trials.join(common, "ledger", "left")
    some = F.col("low") < F.col("high")
    inside = returns.join(common.where("low < high"), "ledger").where((F.col("date") >= F.col("low")) & (F.col("date") < F.col("high")))
    span = F.when(some, F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")))
    return placed.select("ledger", "id", "kind", "counted", span.alias("period")).join(sharpes(inside, ["ledger", "id"]), ["ledger", "id"], "left")


def ledger_report(trials: DataFrame, observed: DataFrame) -> DataFrame:
    """One row a ledger: trials counted and with a Sharpe ratio, status, reasons, what the observed daily returns (ledger, r) show,
    the variance of the trials, the best Sharpe ratio that chance would give, and the chance that the observed one is better.

    Variance, and what rests on it, are null with any reason; ledgers without returns have no observed figures.
    """
    counted = F.col("counted")
    daily = F.col("sharpe") / ROOT
    t = trials.groupBy("ledger").agg(
        F.count_if(counted).alias("trials_counted"), F.count_if(counted & F.col("sharpe").isNotNull()).alias("trials_with_sharpe"), F.countDistinct(F.when(counted, F.col("period"))).alias("periods"),
        F.count_if(counted & F.col("period").isNull()).alias("nowhere"), F.var_samp(F.when(counted, daily)).alias("variance"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("nowhere") > 0, NO_COMMON), F.when(F.col("trials_with_sharpe") < F.col("trials_counted"), MISSING), F.when(F.col("periods") > 1, PERIODS), F.when(F.col("trials_with_sharpe") < 2, FEW)))
    t = t.withColumn("reasons", F.array_join(reasons, "; "))
    fine = F.col("reasons") == ""
    n = F.col("trials_counted").cast("double")
    t = t.withColumn("variance", F.when(fine, F.col("variance")))
    top = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))
    t = t.withColumn("expected_max", F.when(F.col("variance") >= 0, F.sqrt("variance") * top))
    m = observed.groupBy("ledger").agg(F.count("r").alias("days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"))
    flat = ~F.coalesce(F.col("sd") > 0, F.lit(False))
    m = m.select("ledger", "days", F.when(~flat, F.col("mean") / F.col("sd")).alias("sharpe_daily"), *[F.when(~flat, F.col(c)).alias(c) for c in ("skewness", "excess_kurtosis")])
    x = t.join(m, "ledger", "left")
    p = deflated_sharpe(F.col("sharpe_daily"), F.col("expected_max"), F.col("days"), F.col("skewness"), F.col("excess_kurtosis"))
    return x.select(
        "ledger", "trials_counted", "trials_with_sharpe", F.when(fine, "assumption_dependent").otherwise("unavailable").alias("status"), "reasons", F.coalesce("days", F.lit(0)).alias("days"), "sharpe_daily", (F.col("sharpe_daily") * ROOT).alias("sharpe_annual"),
        "skewness", "excess_kurtosis", "variance", F.col("expected_max").alias("expected_max_daily"), (F.col("expected_max") * ROOT).alias("expected_max_annual"), p.alias("probability"),
    )
