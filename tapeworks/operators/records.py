"""Smaller operators of records: spreads, open positions, fees of runs, stakes, growth of days, Kelly's fraction, key sets and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import DAYS_A_YEAR, ordered, stacked

from .resample import kelly_bootstrap
from .trades import kelly


def spread_bps(bid: Column, ask: Column) -> Column:
    """Basis points of the mid price; infinite where that isn't above zero."""
    mid = (bid + ask) / 2
    return F.when(mid <= 0, F.lit(float("inf"))).otherwise((ask - bid) / mid * 10000)


def whole_days(opened: Column, closed: Column) -> Column:
    """Days from opening to closing, rounded to a whole number (halves to the even one), one at least."""
    return F.greatest(F.lit(1), F.bround((F.unix_micros(closed.cast("timestamp")) - F.unix_micros(opened.cast("timestamp"))) / 86_400_000_000, 0).cast("long"))


def open_amounts(orders: DataFrame, listed: DataFrame) -> DataFrame:
    """pair, open_amount, oldest_open of the listed pairs: open orders (pair, amount, is_open, date) summed apart, 0 and null without any."""
    own = orders.where("is_open").groupBy("pair").agg(F.sum("amount").alias("open_amount"), F.min("date").alias("oldest_open"))
    return listed.join(own, "pair", "left").select("pair", F.coalesce("open_amount", F.lit(0).cast(own.schema["open_amount"].dataType)).alias("open_amount"), "oldest_open")


def stakes(trades: DataFrame, fee_by_run: DataFrame, share: Column, least: float, most: float) -> DataFrame:
    """trades (run, ...) with the fee of their run (null: unknown), and the stake: share of `most`, within bounds."""
    return trades.join(fee_by_run, "run", "left").withColumn("stake", F.least(F.lit(most), F.greatest(F.lit(least), share * F.lit(most))))


def sized_entries(entries: DataFrame, sized: DataFrame, floor: float = 0.25) -> DataFrame:
    """entries (pair, trade_id, at, proposed, least, most) with fraction and stake: the proposed stake times the fraction of the
    pair's last row of `sized` (pair, date, fraction) before `at`, the floor where there is none or it is undefined; within the
    bounds, a missing lower one bounds nothing. Both sides are one stream in time order, entries before rows of equal times."""
    null = F.lit(None)
    kind = sized.schema["fraction"].dataType
    held = F.struct(F.col("fraction").cast(kind).alias("fraction"))
    left = entries.select("pair", F.col("at").alias("time"), F.lit(0).alias("kind"), "trade_id", null.cast(f"struct<fraction:{kind.simpleString()}>").alias("held"))
    right = sized.select("pair", F.col("date").alias("time"), F.lit(1).alias("kind"), null.cast(entries.schema["trade_id"].dataType).alias("trade_id"), held.alias("held"))
    w = Window.partitionBy("pair").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stacked(["pair"], left, right).withColumn("held", F.last("held", ignorenulls=True).over(w)).where("kind = 0").select("pair", "trade_id", F.col("held.fraction").alias("__f"))
    defined = F.col("__f").isNotNull() & ~F.isnan("__f")
    x = entries.join(found, ["pair", "trade_id"]).withColumn("fraction", F.when(defined, F.col("__f")).otherwise(F.lit(floor))).drop("__f")
    stake = F.col("proposed") * F.col("fraction")
    return x.withColumn("stake", F.least("most", F.coalesce(F.greatest(stake, F.col("least")), stake)))


def daily_growth(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, days, years, and in percent a year: mean, growth (null after a day that loses all), growth of the mean, and what lies between them."""
    r = F.col(value) / F.lag(value).over(ordered(keys)) - 1
    g = values.withColumn("r", r).groupBy(*keys).agg(F.count("r").alias("days"), (F.datediff(F.max("date"), F.min("date")) / 365).alias("years"), *[(f * DAYS_A_YEAR * 100).alias(k) for k, f in (("mean", F.avg("r")), ("growth", F.when(F.min("r") > -1, F.avg(F.log1p("r")))), ("log_mean", F.log1p(F.avg("r"))))])
    return g.select(*keys, "days", "years", "mean", "growth", "log_mean", (F.col("mean") - F.col("growth")).alias("gap"), (F.col("log_mean") - F.col("growth")).alias("drag"))


def kelly_report(trades: DataFrame, points: int = 401, wide: float = 5.0, reps: int = 50, grid: int = 21) -> DataFrame:
    """run, n, the best fraction up to 1 and up to `wide`, percent growth a trade at four fractions (null: ruin), and over `reps`
    resamples the bounds of the best fraction up to 1 (of `grid` ones) and the share whose best is zero. Null below two trades."""
    r = F.col("return_pct") / 100

    def at(f: float) -> Column:
        return F.when(~F.bool_or(1 + f * r <= 0), 100 * F.avg(F.when(1 + f * r > 0, F.log1p(f * r))))

    own = trades.groupBy("run").agg(F.count("*").alias("n"), *[at(f).alias(f"growth_{int(100 * f)}") for f in (0.25, 0.5, 0.75, 1.0)])
    best, far = (kelly(trades, f, points).select("run", F.col("kelly_fraction").alias(k)) for f, k in ((1.0, "kelly"), (wide, "kelly_wide")))
    spread = kelly_bootstrap(trades, reps, 1.0, grid).toDF("run", "kelly_p5", "kelly_p50", "kelly_p95", "share_zero")
    x = own.join(best, "run").join(far, "run").join(spread, "run")
    return x.select("run", "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in x.columns if c not in ("run", "n")])


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: keys that only one of two tables has."""
    x, y = (t.select(*keys).distinct().withColumn(n, F.lit(True)) for t, n in ((a, "in_a"), (b, "in_b")))
    both = x.join(y, keys, "full_outer").where("in_a is null or in_b is null")
    return both.select(*keys, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))


def latest_values(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys and of each column the latest value that isn't null: a later record replaces only what it states."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v"))))["__v"].alias(c) for c in columns])


def latest_records(rows: DataFrame, keys: list[str], time: str, line: str) -> DataFrame:
    """The whole record of each key that counts once all are read by line: one without a time gives way to any later line, one with
    a time only to a time as late or later. So it is the latest by (time, line), a missing time before all others."""
    rest = [c for c in rows.columns if c not in (*keys, time, line)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(time, line, *rest)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rows.columns if c not in keys])


def unlisted_gaps(candles: DataFrame, known: DataFrame, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """pair, after, before: gaps between neighbouring candles, but those that begin where `known` (pair, after) lists one."""
    nxt = F.lead("date").over(ordered(["pair"]))
    gaps = candles.select("pair", F.col("date").alias("after"), nxt.alias("before")).where(F.col("before") > F.col("after") + F.expr(step))
    return gaps.join(known, ["pair", "after"], "left_anti")


def manifest_errors(actual: DataFrame, listed: DataFrame) -> DataFrame:
    """file, error: files (file, sha256) that the manifest doesn't list, lists with another digest, or lists without their being there."""
    x = actual.join(listed.withColumnRenamed("sha256", "stated"), "file", "full_outer")
    error = F.when(F.col("stated").isNull(), "not listed").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("stated"), "other digest")
    return x.select("file", error.alias("error")).where("error is not null")
