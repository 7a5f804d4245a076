"""Joins between trades, candles, signals and assessments: by equal keys, as of a time, and by interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import differs, hour_of, micros, ordered, so_far, stacked

from .candles import HOUR, target_fraction


def compare_feeds(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, candles, correlation of close changes, median and 95th percentile deviation in basis points; null below 3 rows."""
    both = a.select("pair", "date", F.col("close").alias("x")).join(b.select("pair", "date", F.col("close").alias("y")), ["pair", "date"])
    w = ordered(["pair"])
    both = both.withColumns({"rx": F.col("x") / F.lag("x").over(w) - 1, "ry": F.col("y") / F.lag("y").over(w) - 1, "bps": F.abs(F.col("x") / F.col("y") - 1) * 10000})
    enough = F.count("*") >= 3
    return both.groupBy("pair").agg(F.count("*").alias("candles"), F.when(enough, F.corr("rx", "ry")).alias("correlation"), F.when(enough, F.percentile("bps", 0.5)).alias("median_bps"), F.when(enough, F.percentile("bps", 0.95)).alias("p95_bps"))


def feed_passes(compared: DataFrame, correlation: float = 0.95, bps: float = 50.0) -> DataFrame:
    return compared.withColumn("passes", F.coalesce((F.col("correlation") >= correlation) & (F.col("median_bps") <= bps), F.lit(False)))


def latest_assessments(assessments: DataFrame) -> DataFrame:
    """One row a candidate: the newest by available_at, of equal times the last line; without any time the first line."""
    timed = F.col("available_at").isNotNull()
    order = Window.partitionBy("candidate_id").orderBy(F.desc("available_at"), F.when(timed, -F.col("line")).otherwise(F.col("line")))
    return assessments.where("candidate_id is not null and pair is not null and signal_time is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def match_trades(trades: DataFrame, assessments: DataFrame, max_lag_hours: float, ttl_minutes: float | None = None) -> DataFrame:
    """pair, trade_id, open_date, candidate_id, reason, included.

    A trade meets the latest candidate of its pair up to its opening; a candidate serves its first trade only. Both sides are
    one stream in time order, candidates before trades at equal times.
    """
    pool = latest_assessments(assessments)
    match = F.struct("candidate_id", "signal_time", "available_at", "decision").alias("match")
    left = trades.select("pair", F.col("open_date").alias("at"), F.lit(1).alias("kind"), "trade_id", F.lit(None).cast(pool.select(match).schema[0].dataType).alias("match"))
    right = pool.select("pair", F.col("signal_time").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("trade_id"), match)
    stream = stacked(["pair"], left, right).withColumn("order", F.struct("at", "kind", "trade_id"))
    found = stream.withColumn("match", F.last("match", ignorenulls=True).over(so_far(["pair"], "order"))).where("kind = 1")
    use = F.row_number().over(Window.partitionBy("pair", "match.candidate_id").orderBy("order"))
    found = found.withColumn("first", use == 1)
    lag = micros("at") - micros("match.signal_time")
    none = F.col("match").isNull() | ~F.col("first") | (lag > max_lag_hours * HOUR)
    late = F.col("match.available_at").isNull() | (F.col("match.available_at") >= F.col("at"))
    reason = F.when(none, "no_assessment").when(late, "late_or_missing_availability")
    if ttl_minutes is not None:
        reason = reason.when(micros("match.available_at") + ttl_minutes * 60_000_000 < micros("at"), "expired")
    reason = reason.when(F.coalesce(F.col("match.decision") != "approve", F.lit(True)), "rejected").otherwise("approved")
    out = found.select("pair", "trade_id", F.col("at").alias("open_date"), F.when(~none, F.col("match.candidate_id")).alias("candidate_id"), reason.alias("reason"))
    return out.withColumn("included", F.col("reason") == "approved")


def reference_open(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """trades with the open of the candle that holds their opening, null where there is none."""
    c = candles.select("pair", F.col("date").alias("__hour"), F.col("open").alias("reference_open"))
    return trades.withColumn("__hour", hour_of("open_date")).join(c, ["pair", "__hour"], "left").drop("__hour")


def sized_by_volatility(trades: DataFrame, volatility: DataFrame) -> DataFrame:
    """trades with sigma of the candle before the one of their opening, and the stake fraction for it."""
    v = volatility.select("pair", F.col("date").alias("__hour"), "sigma")
    before = hour_of("open_date") - F.expr("INTERVAL 1 HOUR")
    return trades.withColumn("__hour", before).join(v, ["pair", "__hour"], "left").drop("__hour").withColumn("fraction", target_fraction(F.col("sigma")))


def signal_entries(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """trades with the signal they acted on: the candle before that of their opening, null if it gave none."""
    s = signals.where("enter").select("pair", F.col("date").alias("__hour"), F.col("date").alias("signal_time"))
    before = hour_of("open_date") - F.expr("INTERVAL 1 HOUR")
    return trades.withColumn("__hour", before).join(s, ["pair", "__hour"], "left").drop("__hour")


def in_position(signals: DataFrame, trades: DataFrame) -> DataFrame:
    """pair, date, busy of each entry signal: whether a trade was open then or closed less than one candle before.

    Trades of a pair don't overlap, so the last one opened by then decides.
    """
    s = signals.where("enter").select("pair", "date", F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(False).alias("opened"))
    t = trades.select("pair", F.col("open_date").alias("date"), F.lit(0).alias("kind"), F.col("close_date").alias("until"), F.lit(True).alias("opened"))
    last = F.last(F.when(F.col("opened"), F.struct("until")), ignorenulls=True).over(so_far(["pair"], "order"))
    e = stacked(["pair"], s, t).withColumn("order", F.struct("date", "kind")).withColumn("last", last).where("kind = 1")
    busy = F.col("last").isNotNull() & (F.col("last.until").isNull() | (micros("last.until") + HOUR > micros("date")))
    return e.select("pair", "date", busy.alias("busy"))


def order_rollup(lines: DataFrame) -> DataFrame:
    """o_orderkey, status and what its lines (returned, filled) add up to; ok if it has exactly one filled line."""
    filled = F.col("l_returnflag") != "R"
    return lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("lines"), F.count_if(filled).alias("filled_lines"), F.coalesce(F.sum(F.when(filled, F.round(F.col("l_quantity")).cast("long"))), F.lit(0)).alias("filled_quantity"), (F.count_if(filled) == 1).alias("single_fill"))


def unseen(candidates: DataFrame, assessed: DataFrame) -> DataFrame:
    return candidates.join(assessed.select("candidate_id").distinct(), "candidate_id", "left_anti")


def reconcile(db: DataFrame, exchange: DataFrame, base: Column, since: Column | None = None, absolute: float = 1e-8, relative: float = 1e-6) -> DataFrame:
    """order_id, issue: every way in which two books of orders disagree; an order may have several.

    db: order_id, filled, fee_base, is_open, order_date, line. exchange: order_id, filled, status, fee_cost, fee_currency, line.
    Each row of a book is held against the last line of its id in the other one. Fees are compared where the exchange took them in
    the base currency; with `since`, closed fills from then on must be on the exchange.
    """
    theirs = exchange.groupBy("order_id").agg(F.max_by("status", "line").alias("ex_status"))
    ours = db.groupBy("order_id").agg(F.max_by(F.struct("filled", "fee_base"), "line").alias("db"))

    def off(a: str, b: str) -> Column:
        return differs(F.col(a), F.col(b), absolute, relative)

    x = exchange.where("status = 'closed'").join(ours, "order_id", "left")
    of_exchange = [F.when(F.col("db").isNull(), "missing_db_order"), F.when(off("db.filled", "filled"), "amount_mismatch"), F.when((F.col("fee_currency") == base) & off("db.fee_base", "fee_cost"), "fee_mismatch")]
    d = db.join(theirs, "order_id", "left")
    of_db = [F.when(F.col("is_open") & F.col("ex_status").isin("closed", "canceled"), "stale_open_order")]
    if since is not None:
        of_db.append(F.when(~F.col("is_open") & (F.col("filled") > 0) & (F.col("order_date") >= since) & F.col("ex_status").isNull(), "missing_exchange_order"))
    return reduce(DataFrame.unionByName, [t.select("order_id", F.explode(F.array_compact(F.array(*issues))).alias("issue")) for t, issues in ((x, of_exchange), (d, of_db))])


def lookback_since(orders: DataFrame, since: Column) -> DataFrame:
    """One row, since: the earlier of `since` and the oldest order that is still open, so that a skipped run loses none."""
    return orders.agg(F.least(since, F.coalesce(F.min(F.when(F.col("is_open"), F.col("order_date"))), since)).alias("since"))


def dust(balances: DataFrame, positions: DataFrame, absolute: float, relative: float = 1e-3) -> DataFrame:
    """currency, balance, held, dust: balances (currency, balance) that differ from what open positions (currency, amount) add up to."""
    held = positions.groupBy("currency").agg(F.sum("amount").alias("held"))
    x = balances.where("balance is not null").join(held, "currency", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    return x.where(differs(F.col("balance"), F.col("held"), absolute, relative)).select("currency", "balance", "held", (F.col("balance") - F.col("held")).alias("dust"))


def execution_report(trades: DataFrame, candles: DataFrame, fee: float) -> DataFrame:
    """pair, trades, mean entry slippage in basis points on the candle's open, mean delay in minutes, round-trip cost."""
    t = reference_open(trades.withColumnRenamed("open", "rate"), candles)
    slip = (F.col("rate") / F.col("reference_open") - 1) * 10000
    delay = (micros("open_date") - micros(hour_of("open_date"))) / 60_000_000
    return t.where("reference_open is not null").groupBy("pair").agg(F.count("*").alias("trades"), F.avg(slip).alias("mean_slippage_bps"), F.avg(delay).alias("mean_delay_minutes"), F.max(F.abs(slip) + 2 * fee * 10000).alias("max_round_trip_bps"))
