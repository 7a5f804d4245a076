"""Judging paper trades: contracts, marking, executions, fidelity to signals, criteria, and a paired comparison of sizings.

Paper trades: pair, trade_id, strategy, timeframe, submitted_date (null: unknown), open_date, close_date (null: open), amount,
stake_amount, open_rate, close_rate, fee_open, fee_close, profit_abs, profit_ratio, exit_reason. Candles are hourly. Results
have a row a pair unless they say otherwise; a pair's trades and candles meet in windows and equal keys, never in range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import hour_of, micros, ratio, so_far, stacked

from .candles import HOUR, target_fraction
from .resample import bootstrap_mean
from .risk import daily_marks, drawdowns
from .trades import trade_statistics

PAIR = ["pair"]
STEP = "INTERVAL 1 HOUR"
ASSUMED, STRESS = 0.005, 0.01  # cost a side
CLOSING = ("close_date", "close_rate", "fee_close", "profit_abs", "profit_ratio", "exit_reason")


def _decided() -> Column:
    return F.coalesce("submitted_date", "open_date")


def _bad(x: str) -> Column:
    """Whether a number is null, not finite, or not positive."""
    return ~F.coalesce((F.col(x) > 0) & (F.col(x) < float("inf")) & ~F.isnan(x), F.lit(False))


def _wild(x: str) -> Column:
    return F.coalesce(F.isnan(x) | (F.abs(F.col(x)) == float("inf")), F.lit(False))


def trade_violations(trades: DataFrame, timeframe: str, strategy: str) -> DataFrame:
    """pair, trade_id, issue: every way in which a trade breaks the contract of a window of one strategy and one position."""
    closed = F.col("close_date").isNotNull() | F.col("profit_abs").isNotNull()
    before = F.lag(F.struct(F.coalesce("close_date", F.lit("9999-12-31").cast("timestamp_ntz")).alias("until"))).over(Window.partitionBy("pair").orderBy("open_date", "trade_id"))
    fee = F.coalesce((F.col("fee_open") >= 0) & (F.col("fee_open") < 1), F.lit(False)) & F.coalesce((F.col("fee_close") >= 0) & (F.col("fee_close") < 1), F.lit(True))
    issues = [
        F.when(F.coalesce(F.col("timeframe") != timeframe, F.lit(True)), "other_timeframe"),
        F.when(F.coalesce(F.col("strategy") != strategy, F.lit(True)), "other_strategy"),
        F.when(_bad("amount") | _bad("open_rate") | _bad("stake_amount"), "invalid_fill"),
        F.when(~fee, "invalid_fee"),
        F.when(closed & (F.col("close_date").isNull() | F.col("profit_abs").isNull() | F.col("profit_ratio").isNull()), "incomplete_close"),
        F.when(_wild("profit_abs") | _wild("profit_ratio"), "wild_profit"),
        F.when(closed & _bad("close_rate"), "invalid_exit_rate"),
        F.when(F.col("close_date") < F.col("open_date"), "closes_before_entry"),
        F.when(F.col("open_date") < F.col("before.until"), "overlapping"),
    ]
    t = trades.withColumn("before", before)
    return t.select("pair", "trade_id", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def at_horizon(trades: DataFrame, end: Column) -> DataFrame:
    """The trades as they were known at `end`: later ones are left out, and what closes at or after it is still open."""
    later = F.coalesce(F.col("close_date") >= end, F.lit(False))
    return trades.where(F.col("open_date") < end).withColumns({c: F.when(~later, F.col(c)) for c in CLOSING})


def normalised(trades: DataFrame, notional: float) -> DataFrame:
    """The trades as if each had staked `notional`."""
    scale = notional / F.col("stake_amount")
    return trades.withColumns({"amount": F.col("amount") * scale, "profit_abs": F.col("profit_abs") * scale, "stake_amount": F.lit(notional)})


def at_cost(trades: DataFrame, fee: float) -> DataFrame:
    """The trades as if each side had cost `fee`: what closed ones made follows from their rates."""
    made = F.col("amount") * F.col("close_rate") * (1 - fee) - F.col("amount") * F.col("open_rate") * (1 + fee)
    closed = F.col("close_date").isNotNull()
    t = trades.withColumns({"fee_open": F.lit(fee), "fee_close": F.when(closed, fee), "profit_abs": F.when(closed, made)})
    return t.withColumn("profit_ratio", ratio(F.col("profit_abs"), F.col("amount") * F.col("open_rate") * (1 + fee)))


def marking_frame(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """pair, trade_id, open_date, close_date (of candles), amount, open_rate, fee_open, fee_close, profit_abs.

    An open trade closes at the end of its pair's last candle, at its close, with the entry's fee.
    """
    last = candles.groupBy("pair").agg((F.max("date") + F.expr(STEP)).alias("mark_at"), F.max_by("close", "date").alias("mark"))
    t, held = trades.join(last, "pair"), F.col("close_date").isNull()
    marked = F.col("amount") * F.col("mark") * (1 - F.col("fee_open")) - F.col("amount") * F.col("open_rate") * (1 + F.col("fee_open"))
    return t.select(
        "pair", "trade_id", hour_of("open_date").alias("open_date"), F.when(held, F.col("mark_at")).otherwise(hour_of("close_date")).alias("close_date"), "amount", "open_rate", "fee_open",
        F.when(held, F.col("fee_open")).otherwise(F.coalesce("fee_close", "fee_open")).alias("fee_close"), F.when(held, marked).otherwise(F.coalesce("profit_abs", F.lit(0.0))).alias("profit_abs"),
    )


def equity(frame: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """pair, date, equity at each candle's close: what closed trades made, and the held one's worth after its exit fee."""
    none, kind = F.lit(None).cast("double"), F.lit(None).cast("struct<amount: double, paid: double, fee: double, until: timestamp_ntz>")
    held = F.struct("amount", (F.col("amount") * F.col("open_rate") * (1 + F.col("fee_open"))).alias("paid"), F.col("fee_close").alias("fee"), F.col("close_date").alias("until"))
    closes = frame.select("pair", F.col("close_date").alias("date"), F.lit(0).alias("kind"), F.col("profit_abs").alias("profit"), kind.alias("held"), none.alias("close"))
    opens = frame.select("pair", F.col("open_date").alias("date"), F.lit(1).alias("kind"), none.alias("profit"), held.alias("held"), none.alias("close"))
    marks = candles.select("pair", "date", F.lit(2).alias("kind"), none.alias("profit"), kind.alias("held"), "close")
    e, w = stacked(PAIR, closes, opens, marks).withColumn("order", F.struct("date", "kind")), so_far(PAIR, "order")
    e = e.withColumns({"realised": F.coalesce(F.sum("profit").over(w), F.lit(0.0)), "held": F.last("held", ignorenulls=True).over(w)})
    worth = F.when(F.col("date") < F.col("held.until"), F.col("held.amount") * F.col("close") * (1 - F.col("held.fee")) - F.col("held.paid"))
    return e.where("kind = 2").select("pair", "date", (notional + F.col("realised") + F.coalesce(worth, F.lit(0.0))).alias("equity"))


def marked(frame: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """pair, final_equity, net_return_pct, mtm_max_drawdown_pct (null below 1e-10: rounding is no risk), ratio of the two."""
    d = drawdowns(equity(frame, candles, notional), PAIR, "equity", notional)
    s = d.groupBy("pair").agg(F.max_by("equity", "date").alias("final_equity"), F.max("drawdown_pct").alias("dd"))
    s = s.select("pair", "final_equity", (100 * (F.col("final_equity") / notional - 1)).alias("net_return_pct"), F.when(F.col("dd") < 1e-10, 0.0).otherwise(F.col("dd")).alias("mtm_max_drawdown_pct"))
    return s.withColumn("return_over_drawdown", F.when(F.col("mtm_max_drawdown_pct") > 0, ratio(F.col("net_return_pct"), F.col("mtm_max_drawdown_pct"))))


def performance(trades: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """marked() of trades of a fixed stake, with exposure, and open and closed trades; pairs without trades stay flat."""
    span = candles.groupBy("pair").agg(micros(F.min("date")).alias("start"), (micros(F.max("date")) + HOUR).alias("end"))
    close = F.coalesce(micros("close_date"), F.col("end"))
    held = F.greatest(F.lit(0), F.least(close, F.col("end")) - F.greatest(micros("open_date"), F.col("start")))
    done, pct = F.col("close_date").isNotNull() & F.col("profit_ratio").isNotNull(), 100 * F.col("profit_ratio")
    t = trades.join(span, "pair").groupBy("pair", "start", "end").agg(F.sum(held).alias("held"), F.count_if(F.col("close_date").isNull()).alias("open_trades"), F.count_if(done).alias("closed_trades"), F.count_if(done & (pct > 0)).alias("winners"), F.avg(F.when(done, pct)).alias("mean_pct"))
    t = t.select("pair", (100 * F.col("held") / (F.col("end") - F.col("start"))).alias("exposure_pct"), "open_trades", "closed_trades", "winners", "mean_pct")
    zero = [F.coalesce(c, F.lit(0.0 if c == "exposure_pct" else 0)).alias(c) for c in ("exposure_pct", "open_trades", "closed_trades", "winners")]
    m = marked(marking_frame(trades, candles), candles, notional)
    return m.join(t, "pair", "left").select(*m.columns, *zero, "mean_pct")


def daily_equity(trades: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """pair, day, equity: the last mark of each day."""
    return daily_marks(equity(marking_frame(trades, candles), candles, notional), PAIR, "equity")


def performance_report(trades: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """performance() with all figures of the closed trades, and `refused`: candles that begin after a pair's first trade can't mark
    it, so such a pair has no figures."""
    begin = candles.groupBy("pair").agg(F.min("date").alias("__begin"))
    first = trades.groupBy("pair").agg(F.min("open_date").alias("__first"))
    closed = trades.where("close_date is not null and profit_ratio is not null")
    closed = closed.select(F.col("pair").alias("run"), "trade_id", F.col("open_date").alias("open"), F.col("close_date").alias("close"), (100 * F.col("profit_ratio")).alias("return_pct"), F.coalesce("exit_reason", F.lit("unknown")).alias("exit"))
    figures = trade_statistics(closed).withColumnRenamed("run", "pair").drop("winners", "mean_pct")
    x = performance(trades, candles, notional).join(figures, "pair", "left").join(begin.join(first, "pair", "left"), "pair")
    refused = F.when(F.col("__first") < F.col("__begin"), "candles begin after the first trade")
    shown = [c for c in x.columns if c not in ("pair", "__begin", "__first")]
    return x.select("pair", refused.alias("refused"), *[F.when(refused.isNull(), F.col(c)).alias(c) for c in shown])


def held_worth(candles: DataFrame, notional: float, fee: float = ASSUMED) -> DataFrame:
    """candles with worth: of buying the first open, at each close after the exit fee."""
    return candles.withColumn("worth", notional / (1 + fee) / F.first("open").over(so_far(PAIR)) * F.col("close") * (1 - fee))


def holding(candles: DataFrame, notional: float, fee: float = ASSUMED) -> DataFrame:
    """pair, hold_return_pct, hold_drawdown_pct of buying the first open, each mark after the exit fee."""
    d = drawdowns(held_worth(candles, notional, fee), PAIR, "worth", notional)
    return d.groupBy("pair").agg((100 * (F.max_by("worth", "date") / notional - 1)).alias("hold_return_pct"), F.max("drawdown_pct").alias("hold_drawdown_pct"))


def executions(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """A row a trade: reference opens, slippage in basis points against them, delay, fees, round-trip cost in percent.

    The reference is the open of the candle in which the fill was decided. Only a signal's exit has one: other exits are
    defined by price or by hand.
    """
    c = candles.select("pair", F.col("date").alias("at"), F.col("open").alias("reference"))
    t = trades.withColumns({"in_at": hour_of(_decided()), "out_at": F.when((F.col("exit_reason") == "exit_signal") & F.col("close_date").isNotNull() & (F.col("close_rate") != 0), hour_of("close_date"))})
    t = t.join(c.toDF("pair", "in_at", "entry_reference"), ["pair", "in_at"], "left").join(c.toDF("pair", "out_at", "exit_reference"), ["pair", "out_at"], "left")
    t = t.withColumns({"entry_slippage_bps": 10000 * (ratio(F.col("open_rate"), F.col("entry_reference")) - 1), "exit_slippage_bps": 10000 * (1 - ratio(F.col("close_rate"), F.col("exit_reference"))), "entry_delay_minutes": (micros("open_date") - micros("in_at")) / 60e6})
    cost = (F.col("entry_slippage_bps") + F.col("exit_slippage_bps") + 10000 * (F.col("fee_open") + F.col("fee_close"))) / 100
    return t.select("pair", "trade_id", "entry_reference", "entry_slippage_bps", "entry_delay_minutes", "exit_reference", "exit_slippage_bps", cost.alias("round_trip_cost_pct"), "exit_reason", (100 * F.col("profit_ratio")).alias("profit_pct"))


def execution_summary(own: DataFrame) -> DataFrame:
    """Of executions(): measured round trips, mean, median and most of their cost, mean entry slippage."""
    cost = F.col("round_trip_cost_pct")
    return own.groupBy("pair").agg(F.count(cost).alias("measured"), F.avg(cost).alias("cost_mean"), F.percentile(cost, 0.5).alias("cost_median"), F.max(cost).alias("cost_max"), F.avg("entry_slippage_bps").alias("entry_slippage_bps"))


def first_defined(signals: DataFrame, value: str) -> DataFrame:
    """pair, valid_from: the first candle whose `value` is defined."""
    return signals.where(F.col(value).isNotNull()).groupBy("pair").agg(F.min("date").alias("valid_from"))


def straddling(trades: DataFrame, start: Column) -> DataFrame:
    """The trades that were open when the window started, which forbids to judge it."""
    return trades.where((F.col("open_date") < start) & (F.col("close_date").isNull() | (F.col("close_date") > start)))


def fidelity(signals: DataFrame, trades: DataFrame, acknowledged: DataFrame, start: Column, end: Column, valid_from: Column | None = None) -> DataFrame:
    """Counts of each state of the trades opened in [start, end), and of the signals (pair, date, enter) expected to open one.

    A signal of the candle at S is acted on from S + 1 h to before S + 2 h. Trades decided before the first candle that has a
    defined signal are unverifiable. A signal without a trade is explained if acknowledged (pair, date), if a trade was open
    or had closed less than a candle before, or if its time to act isn't over.
    """
    hour = F.expr(STEP)
    valid = (start - hour) if valid_from is None else valid_from
    s = signals.where(F.col("enter") & (F.col("date") >= valid) & (F.col("date") < end)).select("pair", "date")
    own = trades.where((F.col("open_date") >= start) & (F.col("open_date") < end)).select("pair", "trade_id", _decided().alias("decided"))
    own = own.withColumn("date", hour_of("decided") - hour).join(s.withColumn("given", F.lit(True)), ["pair", "date"], "left")
    own = own.withColumn("state", F.when(F.col("decided") < valid + hour, "unverifiable").when(F.col("given"), "matched").otherwise("unexpected"))
    acted = own.where("state = 'matched'").select("pair", "date").distinct()
    left = s.where(F.col("date") >= start - hour).join(acted, ["pair", "date"], "left_anti").join(acknowledged.select("pair", "date", F.lit(True).alias("known")).distinct(), ["pair", "date"], "left")
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    acts = left.select("pair", (F.col("date") + hour).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("until"), "known")
    held = trades.select("pair", F.col("open_date").alias("at"), F.lit(0).alias("kind"), F.coalesce("close_date", far).alias("until"), F.lit(None).cast("boolean").alias("known"))
    both = stacked(PAIR, acts, held).withColumn("order", F.struct("at", "kind"))
    both = both.withColumn("busy", micros(F.max("until").over(so_far(PAIR, "order"))) + HOUR > micros("at")).where("kind = 1")
    state = F.when(F.col("known"), "acknowledged").when(F.col("busy"), "in_position").when(F.col("at") + hour > end, "window_open").otherwise("unexplained")
    # trades and signals are counted apart and meet as one row a pair
    states = {"own": ("matched", "unexpected", "unverifiable"), "both": ("acknowledged", "in_position", "window_open", "unexplained")}
    sides = [x.groupBy("pair").agg(*[F.count_if(F.col("state") == c).alias(c) for c in states[k]]) for k, x in (("own", own), ("both", both.select("pair", state.alias("state"))))]
    counts = sides[0].join(sides[1], "pair", "full_outer").fillna(0)
    expected = s.where(F.col("date") >= start - hour).groupBy("pair").agg(F.count("*").alias("signals"))
    return counts.join(expected, "pair", "left").select("pair", F.coalesce("signals", F.lit(0)).alias("signals"), *counts.columns[1:], (valid + hour <= start).alias("complete"))


def criteria(performed: DataFrame, costs: DataFrame, faith: DataFrame, max_drawdown_pct: float, min_trades: int) -> DataFrame:
    """F1 (fidelity), F2 (mean cost within the stress assumption), F3 (drawdown), F4 (sample): results, verdict, may_judge."""
    x = performed.join(costs, "pair", "left").join(faith, "pair", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("measured", "signals", "matched", "unexpected", "unverifiable", "unexplained")}
    x = x.withColumns(zero).withColumn("complete", F.coalesce("complete", F.lit(True)))
    clean = (F.col("unexpected") == 0) & (F.col("unexplained") == 0)
    idle = (F.col("signals") == 0) & (F.col("matched") == 0) & (F.col("unexpected") == 0)
    early, passed = "NOT_YET_TESTABLE", lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    f1 = F.when(clean & (~F.col("complete") | (F.col("unverifiable") > 0)) | idle, early).otherwise(passed(clean))
    f2 = F.when(F.col("measured") == 0, early).otherwise(passed(F.round("cost_mean", 4) <= 200 * STRESS))
    f3, f4 = passed(F.round("mtm_max_drawdown_pct", 4) <= max_drawdown_pct), F.when(F.col("closed_trades") >= min_trades, "PASS").otherwise(early)
    x = x.select("pair", f1.alias("f1"), f2.alias("f2"), (F.round("cost_mean", 4) <= 200 * ASSUMED).alias("within_base"), f3.alias("f3"), f4.alias("f4"), F.greatest(F.lit(0), min_trades - F.col("closed_trades")).alias("trades_remaining"))
    stop = (F.col("f1") == "FAIL") | (F.col("f2") == "FAIL") | (F.col("f3") == "FAIL")
    return x.select("*", F.when(stop, "STOP").otherwise("CONTINUE").alias("verdict"), ((F.col("f1") == "PASS") & (F.col("f4") == "PASS")).alias("may_judge"))


def performance_decision(performed: DataFrame, held: DataFrame, judged: DataFrame, trades: DataFrame, limit: float = 0.6, reps: int = 2000) -> DataFrame:
    """P1 (net return above zero), P2 (drawdown within `limit` of holding's), and whether the resampled mean return supports a gain."""
    own = trades.where("close_date is not null and profit_ratio is not null").select("pair", "trade_id", "open_date", (100 * F.col("profit_ratio")).alias("pct"))
    mean = bootstrap_mean(own, PAIR, "pct", ["open_date", "trade_id"], reps)
    x = performed.join(held, "pair").join(judged.select("pair", "may_judge"), "pair").join(mean, "pair", "left")

    def told(ok: Column) -> Column:
        return F.when(~F.col("may_judge"), "NOT_YET_TESTABLE").when(ok, "PASS").otherwise("FAIL")

    p2 = F.round("mtm_max_drawdown_pct", 4) <= F.round(limit * F.round("hold_drawdown_pct", 4), 6)
    return x.select("pair", told(F.round("net_return_pct", 4) > 0).alias("p1"), told(p2).alias("p2"), "low", "high", F.coalesce(F.col("may_judge") & (F.round("low", 6) > 0), F.lit(False)).alias("mean_supported"))


def resized(frame: DataFrame, volatility: DataFrame) -> DataFrame:
    """A marking frame with amounts and profits scaled by the stake fraction of the candle before the entry's; sigma stays, null if undefined."""
    v = volatility.select("pair", (F.col("date") + F.expr(STEP)).alias("open_date"), "sigma")
    f = frame.join(v, ["pair", "open_date"], "left").withColumn("fraction", target_fraction(F.col("sigma")))
    return f.withColumns({"amount": F.col("amount") * F.col("fraction"), "profit_abs": F.col("profit_abs") * F.col("fraction")})


def paired_sizing(frame: DataFrame, volatility: DataFrame, candles: DataFrame, notional: float, min_trades: int, margin: float = 0.2) -> DataFrame:
    """The same trades at full stake and at stakes sized by volatility: both summaries, three criteria, and the verdict."""
    other = resized(frame, volatility)
    a = marked(frame, candles, notional).select("pair", *[F.round(c, 4).alias(f"full_{k}") for c, k in (("net_return_pct", "net"), ("mtm_max_drawdown_pct", "dd"), ("return_over_drawdown", "ratio"))])
    b = marked(other, candles, notional).select("pair", *[F.round(c, 4).alias(f"sized_{k}") for c, k in (("net_return_pct", "net"), ("mtm_max_drawdown_pct", "dd"), ("return_over_drawdown", "ratio"))])
    n = other.groupBy("pair").agg(F.count("*").alias("trades"), F.count_if(F.col("sigma").isNull()).alias("missing"))
    x = a.join(b, "pair").join(n, "pair", "left").withColumns({"trades": F.coalesce("trades", F.lit(0)), "missing": F.coalesce("missing", F.lit(0))})
    gain = F.col("sized_net") > 0
    better = F.when(F.col("sized_ratio").isNull(), F.col("full_ratio").isNotNull() & gain).when(F.col("full_ratio").isNull(), gain).otherwise(F.col("sized_ratio") >= F.col("full_ratio") + margin)
    x = x.withColumns({"less_drawdown": F.col("sized_dd") <= F.col("full_dd"), "better_ratio": better, "gains": gain})
    ready = (F.col("missing") == 0) & (F.col("trades") >= min_trades) & (F.col("full_ratio").isNotNull() | F.col("sized_ratio").isNotNull())
    return x.withColumn("verdict", F.when(~ready, "INCONCLUSIVE").when(F.col("less_drawdown") & F.col("better_ratio") & F.col("gains"), "GO").otherwise("NO_GO"))


def trade_set_summary(trades: DataFrame, candles: DataFrame, notional: float) -> DataFrame:
    """pair, trade_count, net_return_pct, final_equity (realised), mtm_max_drawdown_pct; pairs without trades stay flat."""
    frame = marking_frame(trades.where("close_date is not null"), candles)
    n = frame.groupBy("pair").agg(F.count("*").alias("trade_count"), F.sum("profit_abs").alias("profit"))
    m = marked(frame, candles, notional).select("pair", "mtm_max_drawdown_pct")
    final = notional + F.coalesce("profit", F.lit(0.0))
    return m.join(n, "pair", "left").select("pair", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), (100 * (final / notional - 1)).alias("net_return_pct"), final.alias("final_equity"), "mtm_max_drawdown_pct")
