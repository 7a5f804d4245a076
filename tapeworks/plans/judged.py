"""Queries over paper trades and records, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.columns import rounded
from tapeworks.functions.written import written
from tapeworks.operators import candles as cd
from tapeworks.operators import assessment, forward, matching, records, risk, rules
from tapeworks.sources import views
from tapeworks.sources.views import ASSESSMENTS, BARS, CANDIDATES, DAILY, PAPER, TRADES

from . import sql

START, END, HORIZON, MIDDLE = "2024-01-05 00:00:00", "2024-01-25 00:00:00", "2024-01-20 00:00:00", "2024-01-15 00:00:00"
NOTIONAL, MIN_TRADES, MAX_DRAWDOWN, REPS = 1000.0, 30, 30.0, 200


#: Pairs whose trades all act on a signal.
STRICT = ["click", "error", "view"]


def at(t: str):
    return F.lit(t).cast("timestamp_ntz")


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """Paper trades with a fault of every kind."""
    t, j = views.paper_trades(spark, d), F.col("trade_id") / 5
    return t.withColumns({
        "timeframe": F.when(j % 23 == 1, "4h").otherwise(F.col("timeframe")), "strategy": F.when(j % 19 == 2, "other").otherwise(F.col("strategy")), "amount": F.when(j % 17 == 3, -1.0).when(j % 17 == 4, float("inf")).otherwise(F.col("amount")),
        "fee_open": F.when(j % 13 == 5, 1.5).otherwise(F.col("fee_open")), "fee_close": F.when(j % 13 == 6, -0.1).otherwise(F.col("fee_close")), "profit_ratio": F.when(j % 11 == 7, None).when(j % 11 == 8, float("nan")).otherwise(F.col("profit_ratio")),
        "close_rate": F.when(j % 9 == 1, 0.0).otherwise(F.col("close_rate")), "close_date": F.when(j % 9 == 2, F.col("open_date") - F.expr("INTERVAL 1 HOUR")).when(j % 9 == 3, None).otherwise(F.col("close_date")),
    })


FAULTY = """
faulty AS (SELECT * REPLACE (
  CASE WHEN trade_id // 5 % 23 = 1 THEN '4h' ELSE timeframe END AS timeframe, CASE WHEN trade_id // 5 % 19 = 2 THEN 'other' ELSE strategy END AS strategy,
  CASE WHEN trade_id // 5 % 17 = 3 THEN -1.0::DOUBLE WHEN trade_id // 5 % 17 = 4 THEN 'inf'::DOUBLE ELSE amount END AS amount,
  CASE WHEN trade_id // 5 % 13 = 5 THEN 1.5::DOUBLE ELSE fee_open END AS fee_open, CASE WHEN trade_id // 5 % 13 = 6 THEN -0.1::DOUBLE ELSE fee_close END AS fee_close,
  CASE WHEN trade_id // 5 % 11 = 7 THEN NULL WHEN trade_id // 5 % 11 = 8 THEN 'nan'::DOUBLE ELSE profit_ratio END AS profit_ratio, CASE WHEN trade_id // 5 % 9 = 1 THEN 0.0::DOUBLE ELSE close_rate END AS close_rate,
  CASE WHEN trade_id // 5 % 9 = 2 THEN open_date - INTERVAL 1 HOUR WHEN trade_id // 5 % 9 = 3 THEN NULL ELSE close_date END AS close_date) FROM paper)"""


def rising(spark: SparkSession, d: str) -> DataFrame:
    """pair, date, enter: a signal at each candle that closes above the one before; undefined at the first."""
    before = F.lag("close").over(cd.ordered(["pair"]))
    return views.bars(spark, d).select("pair", "date", F.coalesce(F.col("close") > before, F.lit(False)).alias("enter"), before.alias("before"))


RISING = "rising AS (SELECT pair, date, coalesce(close > lag(close) OVER w, false) AS enter, lag(close) OVER w AS before FROM bars WINDOW w AS (PARTITION BY pair ORDER BY date))"


def acting(spark: SparkSession, d: str) -> DataFrame:
    """Paper trades, for some pairs only those that act on a signal."""
    s = rising(spark, d).where("enter").select("pair", F.col("date").alias("signal"), F.lit(True).alias("given"))
    t = views.paper_trades(spark, d).withColumn("signal", F.date_trunc("hour", F.coalesce("submitted_date", "open_date").cast("timestamp")).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"))
    return t.join(s, ["pair", "signal"], "left").where(~F.col("pair").isin(STRICT) | F.col("given")).drop("signal", "given")


ACTING = "acting AS (SELECT p.* FROM paper p LEFT JOIN rising r ON r.pair = p.pair AND r.enter AND r.date = date_trunc('hour', coalesce(submitted_date, open_date)) - INTERVAL 1 HOUR WHERE p.pair NOT IN ('click', 'error', 'view') OR r.pair IS NOT NULL)"


def known(spark: SparkSession, d: str) -> DataFrame:
    """Signals that the operator has acknowledged: all of the pairs that act on signals only, and every tenth hour of the others."""
    return rising(spark, d).where("enter").where(F.col("pair").isin(STRICT) | (F.hour(F.col("date").cast("timestamp")) % 10 == 0)).select("pair", "date")


KNOWN = "known AS (SELECT pair, date FROM rising WHERE enter AND (pair IN ('click', 'error', 'view') OR hour(date) % 10 = 0))"


def trade_validation(spark, d):
    return forward.trade_violations(faulty(spark, d), "1h", "walk")


def trade_horizon(spark, d):
    return rounded(forward.at_horizon(views.paper_trades(spark, d), at(HORIZON)).select("pair", "trade_id", "open_date", "close_date", "exit_reason", "profit_abs"))


def marking_frame(spark, d):
    return rounded(_frame(spark, d), 9)


def _frame(spark, d):
    return forward.marking_frame(forward.normalised(forward.at_horizon(views.paper_trades(spark, d), at(HORIZON)), NOTIONAL), views.bars(spark, d))


FRAME = f"""
horizon AS (SELECT * REPLACE (CASE WHEN close_date >= '{HORIZON}' THEN NULL ELSE close_date END AS close_date, CASE WHEN close_date >= '{HORIZON}' THEN NULL ELSE exit_reason END AS exit_reason, CASE WHEN close_date >= '{HORIZON}' THEN NULL ELSE profit_abs END AS profit_abs) FROM paper WHERE open_date < '{HORIZON}'),
lastbar AS (SELECT pair, max(date) + INTERVAL 1 HOUR AS mark_at, arg_max(close, date) AS mark, min(date) AS first_at FROM bars GROUP BY pair)"""


def _frame_sql(trades: str, name: str) -> str:
    """A marking frame of trades whose stakes are made NOTIONAL."""
    return f"""
{name}_n AS (SELECT * REPLACE (amount * 1000 / stake_amount AS amount, profit_abs * 1000 / stake_amount AS profit_abs) FROM {trades}),
{name} AS (SELECT t.pair, trade_id, date_trunc('hour', open_date) AS open_date, CASE WHEN close_date IS NULL THEN mark_at ELSE date_trunc('hour', close_date) END AS close_date, amount, open_rate, fee_open,
  CASE WHEN close_date IS NULL THEN fee_open ELSE coalesce(fee_close, fee_open) END AS fee_close, CASE WHEN close_date IS NULL THEN amount * mark * (1 - fee_open) - amount * open_rate * (1 + fee_open) ELSE coalesce(profit_abs, 0) END AS profit_abs FROM {name}_n t JOIN lastbar USING (pair))"""


def _marked_sql(frame: str, name: str) -> str:
    return f"""
{name}_real AS (SELECT pair, close_date, sum(sum(profit_abs)) OVER (PARTITION BY pair ORDER BY close_date) AS realised FROM {frame} GROUP BY pair, close_date),
{name}_e AS (SELECT b.pair, b.date, 1000 + coalesce(r.realised, 0) + coalesce(CASE WHEN b.date < f.close_date THEN f.amount * b.close * (1 - f.fee_close) - f.amount * f.open_rate * (1 + f.fee_open) END, 0) AS equity
  FROM bars b ASOF LEFT JOIN {name}_real r ON b.pair = r.pair AND b.date >= r.close_date ASOF LEFT JOIN {frame} f ON b.pair = f.pair AND b.date >= f.open_date),
{name}_p AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM {name}_e),
{name}_s AS (SELECT pair, arg_max(equity, date) AS final_equity, 100 * (arg_max(equity, date) / 1000 - 1) AS net_return_pct, CASE WHEN max(100 * (peak - equity) / peak) < 1e-10 THEN 0 ELSE max(100 * (peak - equity) / peak) END AS mtm_max_drawdown_pct FROM {name}_p GROUP BY pair),
{name} AS (SELECT *, CASE WHEN mtm_max_drawdown_pct > 0 THEN net_return_pct / mtm_max_drawdown_pct END AS return_over_drawdown FROM {name}_s)"""


@views.candles_once
def forward_performance(spark, d):
    return rounded(_performance(spark, d), 4)


def _performance(spark, d):
    return forward.performance(forward.normalised(acting(spark, d), NOTIONAL), views.bars(spark, d), NOTIONAL)


PERFORMANCE = _frame_sql("acting", "frame") + "," + _marked_sql("frame", "run") + """,
per AS (SELECT a.pair, 100.0::DOUBLE * sum(greatest(0, epoch_us(least(coalesce(close_date, mark_at), mark_at)) - epoch_us(greatest(open_date, first_at)))) / max(epoch_us(mark_at) - epoch_us(first_at)) AS exposure_pct, count(*) FILTER (close_date IS NULL) AS open_trades, count(*) FILTER (close_date IS NOT NULL) AS closed_trades,
  count(*) FILTER (close_date IS NOT NULL AND profit_ratio > 0) AS winners, avg(100 * profit_ratio) FILTER (close_date IS NOT NULL) AS mean_pct FROM acting a JOIN lastbar USING (pair) GROUP BY a.pair),
performed AS (SELECT r.*, coalesce(exposure_pct, 0) AS exposure_pct, coalesce(open_trades, 0) AS open_trades, coalesce(closed_trades, 0) AS closed_trades, coalesce(winners, 0) AS winners, mean_pct FROM run r LEFT JOIN per USING (pair))"""


@views.candles_once
def performance_report(spark, d):
    """The candles of one pair begin too late for its trades."""
    late = views.bars(spark, d).where((F.col("pair") != "signup") | (F.col("date") >= at("2024-01-03 00:00:00")))
    x = forward.performance_report(forward.normalised(acting(spark, d), NOTIONAL), late, NOTIONAL)
    return rounded(x.select(*[(F.col(c) + 1e-9).alias(c) if k == "double" else c for c, k in x.dtypes]), 4)  # off the ties


@views.candles_once
def equity_daily(spark, d):
    return rounded(forward.daily_equity(forward.normalised(acting(spark, d), NOTIONAL), views.bars(spark, d), NOTIONAL), 6)


@views.candles_once
def run_assessment(spark, d):
    """The pairs as runs: closed paper trades, and daily marks of their equity and of holding."""
    t, b = forward.normalised(acting(spark, d), NOTIONAL), views.bars(spark, d)
    closed = t.where("close_date is not null and profit_ratio is not null").select(F.col("pair").alias("run"), "trade_id", F.col("open_date").alias("open"), F.col("close_date").alias("close"), (100 * F.col("profit_ratio")).alias("return_pct"), F.coalesce("exit_reason", F.lit("unknown")).alias("exit"))
    own = forward.daily_equity(t, b, NOTIONAL).select(F.col("pair").alias("run"), F.col("day").alias("date"), F.round("equity", 6).alias("strategy"))
    held = risk.daily_marks(forward.held_worth(b, NOTIONAL), ["pair"], "worth").select(F.col("pair").alias("run"), F.col("day").alias("date"), F.round("worth", 6).alias("buy_hold"))
    values = written(own.join(held, ["run", "date"]), "values")
    parts = assessment.assess_parts(written(closed, "closed"), values, NOTIONAL, 2.0, REPS, 50, 5)
    near = {k: rounded(v.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else c for c, t in v.dtypes]), 4) for k, v in parts.items()}  # off the ties
    return assessment.assess_runs(near, values.select("run").distinct())


def trade_executions(spark, d):
    return rounded(forward.executions(views.paper_trades(spark, d), views.bars(spark, d)), 6)


def execution_summary(spark, d):
    return rounded(forward.execution_summary(forward.executions(views.paper_trades(spark, d), views.bars(spark, d))), 4)


def _executions_sql(trades: str) -> str:
    return f"""
priced AS (SELECT t.*, date_trunc('hour', coalesce(submitted_date, open_date)) AS in_at, i.open AS entry_reference, o.open AS exit_reference FROM {trades} t LEFT JOIN bars i ON i.pair = t.pair AND i.date = date_trunc('hour', coalesce(submitted_date, open_date))
  LEFT JOIN bars o ON o.pair = t.pair AND o.date = date_trunc('hour', close_date) AND exit_reason = 'exit_signal'),
slipped AS (SELECT *, 10000 * (open_rate / entry_reference - 1) AS entry_slippage_bps, 10000 * (1 - close_rate / exit_reference) AS exit_slippage_bps, (epoch_us(open_date) - epoch_us(in_at)) / 60e6 AS entry_delay_minutes FROM priced),
executed AS (SELECT *, (entry_slippage_bps + exit_slippage_bps + 10000 * (fee_open + fee_close)) / 100 AS round_trip_cost_pct, 100 * profit_ratio AS profit_pct FROM slipped)"""


@views.candles_once
def signal_fidelity(spark, d):
    return _fidelity(spark, d)


def _fidelity(spark, d):
    return forward.fidelity(rising(spark, d), acting(spark, d), known(spark, d), at(START), at(END), at("2024-01-05 06:00:00"))


FIDELITY = f"""
s AS (SELECT pair, date FROM rising WHERE enter AND date >= '2024-01-05 06:00:00' AND date < '{END}'),
tr AS (SELECT a.pair, coalesce(submitted_date, open_date) AS decided, date_trunc('hour', coalesce(submitted_date, open_date)) - INTERVAL 1 HOUR AS date FROM acting a WHERE open_date >= '{START}' AND open_date < '{END}'),
ts AS (SELECT tr.pair, tr.date, CASE WHEN decided < TIMESTAMP '2024-01-05 07:00:00' THEN 'unverifiable' WHEN s.pair IS NOT NULL THEN 'matched' ELSE 'unexpected' END AS state FROM tr LEFT JOIN s ON s.pair = tr.pair AND s.date = tr.date),
rest AS (SELECT s.*, k.pair IS NOT NULL AS known FROM s ANTI JOIN (SELECT * FROM ts WHERE state = 'matched') m USING (pair, date) LEFT JOIN known k ON k.pair = s.pair AND k.date = s.date),
ss AS (SELECT pair, CASE WHEN known THEN 'acknowledged' WHEN EXISTS (SELECT 1 FROM acting a WHERE a.pair = rest.pair AND a.open_date <= rest.date + INTERVAL 1 HOUR AND (a.close_date IS NULL OR a.close_date > rest.date)) THEN 'in_position' WHEN rest.date + INTERVAL 2 HOUR > TIMESTAMP '{END}' THEN 'window_open' ELSE 'unexplained' END AS state FROM rest),
st AS (SELECT pair, state FROM ts UNION ALL SELECT pair, state FROM ss), sn AS (SELECT pair, count(*) AS signals FROM s GROUP BY pair),
faith AS (SELECT st.pair, coalesce(max(signals), 0) AS signals, {", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ("matched", "unexpected", "unverifiable", "acknowledged", "in_position", "window_open", "unexplained"))}, false AS complete FROM st LEFT JOIN sn USING (pair) GROUP BY st.pair)"""


def _judged(spark, d):
    """Criteria of a window that is covered: the first hours of the fidelity window are left out of the question."""
    costs = forward.execution_summary(forward.executions(acting(spark, d), views.bars(spark, d)))
    faith = _fidelity(spark, d).withColumns({"complete": F.col("pair") != "view", "unverifiable": F.lit(0)})
    return forward.criteria(_performance(spark, d), costs, faith, MAX_DRAWDOWN, MIN_TRADES)


@views.candles_once
def forward_criteria(spark, d):
    return _judged(spark, d)


CRITERIA = """
costs AS (SELECT pair, count(round_trip_cost_pct) AS measured, round(avg(round_trip_cost_pct), 4) AS cost FROM executed GROUP BY pair),
facts AS (SELECT p.pair, round(mtm_max_drawdown_pct, 4) AS dd, closed_trades, coalesce(measured, 0) AS measured, cost, coalesce(signals, 0) AS signals, coalesce(matched, 0) AS matched, coalesce(unexpected, 0) AS unexpected, coalesce(unexplained, 0) AS unexplained, f.pair IS NULL OR p.pair <> 'view' AS complete FROM performed p LEFT JOIN costs USING (pair) LEFT JOIN faith f USING (pair)),
f14 AS (SELECT pair, CASE WHEN NOT complete AND unexpected = 0 AND unexplained = 0 OR signals = 0 AND matched = 0 AND unexpected = 0 THEN 'NOT_YET_TESTABLE' WHEN unexpected = 0 AND unexplained = 0 THEN 'PASS' ELSE 'FAIL' END AS f1,
  CASE WHEN measured = 0 THEN 'NOT_YET_TESTABLE' WHEN cost <= 2 THEN 'PASS' ELSE 'FAIL' END AS f2, cost <= 1 AS within_base, CASE WHEN dd <= 30 THEN 'PASS' ELSE 'FAIL' END AS f3, CASE WHEN closed_trades >= 30 THEN 'PASS' ELSE 'NOT_YET_TESTABLE' END AS f4, greatest(0, 30 - closed_trades) AS trades_remaining FROM facts),
judged AS (SELECT *, CASE WHEN 'FAIL' IN (f1, f2, f3) THEN 'STOP' ELSE 'CONTINUE' END AS verdict, f1 = 'PASS' AND f4 = 'PASS' AS may_judge FROM f14)"""


@views.candles_once
def performance_decision(spark, d):
    held = forward.holding(views.bars(spark, d), NOTIONAL)
    return rounded(forward.performance_decision(_performance(spark, d), held, _judged(spark, d), acting(spark, d), reps=REPS))


DECISION = """
w AS (SELECT pair, date, 1000 / 1.005::DOUBLE / first(open) OVER o * close * 0.995::DOUBLE AS worth FROM bars WINDOW o AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)),
wp AS (SELECT *, greatest(1000, max(worth) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM w), held AS (SELECT pair, round(max(100 * (peak - worth) / peak), 4) AS dd FROM wp GROUP BY pair),
bt AS (SELECT pair, 100 * profit_ratio AS x, row_number() OVER (PARTITION BY pair ORDER BY open_date, trade_id) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM acting WHERE close_date IS NOT NULL AND profit_ratio IS NOT NULL),
bd AS (SELECT pair, rep, ((rep * n + i) * 1103515245 + 12345) % 2147483648 % n AS i FROM bt, range(200) r(rep)), bm AS (SELECT pair, rep, round(avg(x), 9) AS mean FROM bd JOIN bt USING (pair, i) GROUP BY ALL),
ci AS (SELECT pair, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM bm GROUP BY pair)"""


def straddling_trades(spark, d):
    return forward.straddling(views.paper_trades(spark, d), at("2024-01-10 12:00:00")).select("pair", "trade_id", "open_date", "close_date")


def first_signal(spark, d):
    return forward.first_defined(cd.channels(views.bars(spark, d)), "entry_high")


@views.candles_once
def paired_sizing(spark, d):
    frame = forward.marking_frame(forward.normalised(acting(spark, d), NOTIONAL), views.bars(spark, d))
    late = frame.where(F.col("open_date") >= at(START))
    wild = cd.realized_volatility(views.bars(spark, d)).withColumn("sigma", 2 * F.col("sigma"))  # so that stakes are cut
    return rounded(forward.paired_sizing(late, wild, views.bars(spark, d), NOTIONAL, MIN_TRADES), 3)


@views.candles_once
def filtered_summary(spark, d):
    """Summaries of all trades and of those whose assessment approved them."""
    t, b = forward.normalised(views.paper_trades(spark, d), NOTIONAL), views.bars(spark, d)
    ok = matching.match_trades(t.select("pair", "trade_id", "open_date"), views.assessments(spark, d), 3.0).where("included").select("pair", "trade_id")
    both = [forward.trade_set_summary(x, b, NOTIONAL).withColumn("kind", F.lit(k)) for x, k in ((t, "baseline"), (t.join(ok, ["pair", "trade_id"], "left_semi"), "filtered"))]
    return rounded(both[0].unionByName(both[1]), 4)


def _matched_sql() -> str:
    return """
am AS (SELECT e.pair, e.trade_id, e.open_date, l.candidate_id, l.signal_time, l.available_at, l.decision FROM paper e ASOF LEFT JOIN latest l ON e.pair = l.pair AND e.open_date >= l.signal_time),
au AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY open_date, trade_id) AS use FROM am),
approved AS (SELECT pair, trade_id FROM au WHERE candidate_id IS NOT NULL AND use = 1 AND open_date - signal_time <= INTERVAL 3 HOUR AND available_at < open_date AND decision = 'approve'),
alltrades AS (SELECT * FROM paper WHERE close_date IS NOT NULL), oktrades AS (SELECT * FROM alltrades SEMI JOIN approved USING (pair, trade_id))"""


def spread_bps(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("bid"))
    return rounded(o.select("o_orderkey", records.spread_bps(F.col("bid"), F.col("bid") * (1 + (F.col("o_orderkey") % 7) / 10000.0)).alias("bps")))


def holding_days(spark, d):
    return views.trades(spark, d).select("run", "trade_id", records.whole_days(F.col("open"), F.col("close")).alias("days"))


def open_positions(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderpriority").alias("pair"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), (F.col("o_orderstatus") == "O").alias("is_open"), F.to_date("o_orderdate").alias("date"))
    listed = o.select("pair").distinct().unionByName(spark.createDataFrame([("none",)], "pair string"))
    return records.open_amounts(o.where("pair <> '5-LOW'"), listed)


def run_stakes(spark, d):
    fees = spark.createDataFrame([(k, 0.001 * k) for k in range(7)], "run long, fee double")
    own = views.trades(spark, d).select(F.col("run").cast("long").alias("run"), "trade_id", ((F.col("trade_id") % 13) / 10.0).alias("share"))
    return rounded(records.stakes(own, fees, F.col("share"), 250.0, 1000.0).select("run", "trade_id", "fee", "stake"))


def entry_stakes(spark, d):
    """Stakes of entries in the middle of candles, by the fraction for the volatility of the last candle before."""
    v = cd.realized_volatility(views.bars(spark, d))
    sized = v.select("pair", "date", F.when(F.col("sigma").isNotNull(), cd.target_fraction(2 * F.col("sigma"))).alias("fraction"))
    e = views.entries(spark, d).select("pair", "trade_id", F.when(F.col("trade_id") % 2 == 0, F.col("open_date")).otherwise(F.date_trunc("hour", F.col("open_date").cast("timestamp")).cast("timestamp_ntz")).alias("at"), (100.0 + F.col("trade_id") % 9 * 50).alias("proposed"), F.when(F.col("trade_id") % 3 != 0, 90.0).alias("least"), F.lit(260.0).alias("most"))
    return rounded(records.sized_entries(e, sized))


def daily_growth(spark, d):
    return rounded(records.daily_growth(views.daily(spark, d), ["run"], "strategy"), 4)


def kelly_report(spark, d):
    return rounded(records.kelly_report(views.trades(spark, d)), 4)


def key_sets(spark, d):
    return records.key_difference(views.bars(spark, d), views.feed_b(spark, d), ["pair", "date"])


def latest_values(spark, d):
    a = views.assessments(spark, d)
    return records.latest_values(a, ["candidate_id"], ["line"], ["available_at", "decision"])


def gap_whitelist(spark, d):
    b = views.feed_b(spark, d)
    known = b.where(F.dayofmonth(F.col("date").cast("timestamp")) % 2 == 0).select("pair", F.col("date").alias("after"))
    return records.unlisted_gaps(b, known)


def manifest_check(spark, d):
    """The documents as files: a manifest that leaves some out, states other digests, and lists one that isn't there."""
    own = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("sha256"), "doc_id")
    stated = own.where("doc_id % 10 <> 3").select("file", F.when(F.col("doc_id") % 10 == 4, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return records.manifest_errors(own.drop("doc_id"), stated.unionByName(spark.createDataFrame([("gone", "1")], "file string, sha256 string")))


def unseen_left(spark, d):
    """Candidates without an assessment that has come by a time."""
    seen = views.assessments(spark, d).where(F.col("available_at") < at(HORIZON))
    return matching.unseen(views.candidates(spark, d), seen).select("candidate_id", "pair", "signal_time")



ISSUES = {
    "other_timeframe": "timeframe <> '1h'", "other_strategy": "strategy <> 'walk'", "invalid_fill": "NOT (amount > 0 AND isfinite(amount) AND open_rate > 0 AND stake_amount > 0)", "invalid_fee": "NOT (fee_open >= 0 AND fee_open < 1) OR NOT coalesce(fee_close >= 0 AND fee_close < 1, true)",
    "incomplete_close": "closed AND (close_date IS NULL OR profit_abs IS NULL OR profit_ratio IS NULL)", "wild_profit": "coalesce(NOT isfinite(profit_ratio), false)", "invalid_exit_rate": "closed AND NOT coalesce(close_rate > 0, false)", "closes_before_entry": "close_date < open_date", "overlapping": "open_date < until",
}


def _r(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_BASE = (BARS, PAPER, RISING, ACTING, FRAME)
SQL: dict[str, str] = {
    "trade_validation": sql.ctes(BARS, PAPER, FAULTY, "x AS (SELECT *, close_date IS NOT NULL OR profit_abs IS NOT NULL AS closed, lag(coalesce(close_date, TIMESTAMP '9999-12-31')) OVER (PARTITION BY pair ORDER BY open_date, trade_id) AS until FROM faulty)")
    + " UNION ALL ".join(f"SELECT pair, trade_id, '{k}' AS issue FROM x WHERE {v}" for k, v in ISSUES.items()),
    "trade_horizon": sql.ctes(BARS, PAPER, FRAME) + "SELECT pair, trade_id, open_date, close_date, exit_reason, round(profit_abs, 6) AS profit_abs FROM horizon",
    "marking_frame": sql.ctes(BARS, PAPER, FRAME, _frame_sql("horizon", "frame")) + f"SELECT pair, trade_id, open_date, close_date, {_r('amount open_rate fee_open fee_close profit_abs', 9)} FROM frame",
    "forward_performance": sql.ctes(*_BASE, PERFORMANCE) + f"SELECT pair, {_r('final_equity net_return_pct mtm_max_drawdown_pct return_over_drawdown exposure_pct mean_pct')}, open_trades, closed_trades, winners FROM performed",
    "performance_report": sql.ctes(
        *_BASE, PERFORMANCE, "trades AS (SELECT pair AS run, trade_id, open_date AS open, close_date AS close, 100 * profit_ratio AS return_pct, coalesce(exit_reason, 'unknown') AS exit FROM acting WHERE close_date IS NOT NULL AND profit_ratio IS NOT NULL)",
        f"stats AS (WITH {sql.ALL['trade_stats'].removeprefix('WITH ' + TRADES + ', ')})",
        "begins AS (SELECT pair, min(date) AS b FROM bars WHERE pair <> 'signup' OR date >= '2024-01-03' GROUP BY pair)", "firsts AS (SELECT pair, min(open_date) AS f FROM acting GROUP BY pair)",
        "told AS (SELECT p.*, s.* EXCLUDE (run, winners, mean_pct), CASE WHEN f < b THEN 'candles begin after the first trade' END AS refused FROM performed p LEFT JOIN stats s ON s.run = p.pair JOIN begins USING (pair) LEFT JOIN firsts USING (pair))",
    )
    + "SELECT pair, refused, " + ", ".join(f"CASE WHEN refused IS NULL THEN round({c} + 1e-9, 4) END AS {c}" for c in "final_equity net_return_pct mtm_max_drawdown_pct return_over_drawdown exposure_pct mean_pct".split())
    + ", " + ", ".join(f"CASE WHEN refused IS NULL THEN {c} END AS {c}" for c in "open_trades closed_trades winners count win_rate_pct sd_pct t_stat sum_pct profit_factor mean_win_pct mean_loss_pct payoff_ratio top2_pp rest_pp median_holding_days mean_holding_days exit_exit_signal exit_force_exit exit_stop_loss longest_losing_streak".split()) + " FROM told",
    "equity_daily": sql.ctes(*_BASE, PERFORMANCE) + "SELECT pair, CAST(date AS DATE) AS day, round(arg_max(equity, date), 6) AS equity FROM run_e GROUP BY ALL",
    "trade_executions": sql.ctes(BARS, PAPER, _executions_sql("paper")) + f"SELECT pair, trade_id, exit_reason, {_r('entry_reference entry_slippage_bps entry_delay_minutes exit_reference exit_slippage_bps round_trip_cost_pct profit_pct', 6)} FROM executed",
    "execution_summary": sql.ctes(BARS, PAPER, _executions_sql("paper")) + "SELECT pair, count(round_trip_cost_pct) AS measured, round(avg(round_trip_cost_pct), 4) AS cost_mean, round(quantile_cont(round_trip_cost_pct, 0.5), 4) AS cost_median, round(max(round_trip_cost_pct), 4) AS cost_max, round(avg(entry_slippage_bps), 4) AS entry_slippage_bps FROM executed GROUP BY pair",
    "signal_fidelity": sql.ctes(*_BASE, KNOWN, FIDELITY) + "SELECT * FROM faith",
    "forward_criteria": sql.ctes(*_BASE, KNOWN, FIDELITY, PERFORMANCE, _executions_sql("acting"), CRITERIA) + "SELECT * FROM judged",
    "performance_decision": sql.ctes(*_BASE, KNOWN, FIDELITY, PERFORMANCE, _executions_sql("acting"), CRITERIA, DECISION)
    + "SELECT p.pair, CASE WHEN NOT may_judge THEN 'NOT_YET_TESTABLE' WHEN round(net_return_pct, 4) > 0 THEN 'PASS' ELSE 'FAIL' END AS p1, CASE WHEN NOT may_judge THEN 'NOT_YET_TESTABLE' WHEN round(mtm_max_drawdown_pct, 4) <= round(0.6 * held.dd, 6) THEN 'PASS' ELSE 'FAIL' END AS p2, low, high, coalesce(may_judge AND low > 0, false) AS mean_supported FROM performed p JOIN held USING (pair) JOIN judged USING (pair) LEFT JOIN ci USING (pair)",
    "straddling_trades": sql.ctes(BARS, PAPER) + "SELECT pair, trade_id, open_date, close_date FROM paper WHERE open_date < '2024-01-10 12:00:00' AND (close_date IS NULL OR close_date > '2024-01-10 12:00:00')",
    "first_signal": sql.ctes(BARS, sql.SIGNALS) + "SELECT pair, min(date) AS valid_from FROM sig WHERE entry_high IS NOT NULL GROUP BY pair",
    "paired_sizing": sql.ctes(*_BASE, sql.VOL, _frame_sql("acting", "every"), f"frame AS (SELECT * FROM every WHERE open_date >= '{START}')", "sized0 AS (SELECT f.*, v.sigma, CASE WHEN sigma IS NULL OR sigma <= 0 THEN 0.25::DOUBLE ELSE least(1, greatest(0.25::DOUBLE, 0.4::DOUBLE / (2 * sigma))) END AS fraction FROM frame f LEFT JOIN vol v ON v.pair = f.pair AND v.date = f.open_date - INTERVAL 1 HOUR)",
        "sized AS (SELECT * REPLACE (amount * fraction AS amount, profit_abs * fraction AS profit_abs) FROM sized0)", _marked_sql("frame", "a"), _marked_sql("sized", "b"), "n AS (SELECT pair, count(*) AS trades, count(*) FILTER (sigma IS NULL) AS missing FROM sized GROUP BY pair)",
        "x AS (SELECT a.pair, round(a.net_return_pct, 4) AS full_net, round(a.mtm_max_drawdown_pct, 4) AS full_dd, round(a.return_over_drawdown, 4) AS full_ratio, round(b.net_return_pct, 4) AS sized_net, round(b.mtm_max_drawdown_pct, 4) AS sized_dd, round(b.return_over_drawdown, 4) AS sized_ratio, coalesce(trades, 0) AS trades, coalesce(missing, 0) AS missing FROM a JOIN b USING (pair) LEFT JOIN n USING (pair))",
        "y AS (SELECT *, sized_dd <= full_dd AS less_drawdown, CASE WHEN sized_ratio IS NULL THEN full_ratio IS NOT NULL AND sized_net > 0 WHEN full_ratio IS NULL THEN sized_net > 0 ELSE sized_ratio >= full_ratio + 0.2 END AS better_ratio, sized_net > 0 AS gains FROM x)")
    + f"SELECT pair, {_r('full_net full_dd full_ratio sized_net sized_dd sized_ratio', 3)}, trades, missing, less_drawdown, better_ratio, gains, CASE WHEN NOT (missing = 0 AND trades >= 30 AND (full_ratio IS NOT NULL OR sized_ratio IS NOT NULL)) THEN 'INCONCLUSIVE' WHEN less_drawdown AND better_ratio AND gains THEN 'GO' ELSE 'NO_GO' END AS verdict FROM y",
    "filtered_summary": sql.ctes(BARS, PAPER, FRAME, CANDIDATES, ASSESSMENTS, sql.LATEST, _matched_sql(), _frame_sql("alltrades", "fa"), _marked_sql("fa", "ma"), _frame_sql("oktrades", "fb"), _marked_sql("fb", "mb"))
    + " UNION ALL ".join(f"SELECT m.pair, '{k}' AS kind, coalesce(n.c, 0) AS trade_count, round(100 * ((1000 + coalesce(n.s, 0)) / 1000 - 1), 4) AS net_return_pct, round(1000 + coalesce(n.s, 0), 4) AS final_equity, round(m.mtm_max_drawdown_pct, 4) AS mtm_max_drawdown_pct FROM {m} m LEFT JOIN (SELECT pair, count(*) AS c, sum(profit_abs) AS s FROM {f} GROUP BY pair) n USING (pair)" for k, m, f in (("baseline", "ma", "fa"), ("filtered", "mb", "fb"))),
    "spread_bps": "WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END AS bid FROM orders), z AS (SELECT *, bid * (1 + (o_orderkey % 7) / 10000.0::DOUBLE) AS ask FROM q) SELECT o_orderkey, CASE WHEN (bid + ask) / 2 > 0 THEN round((ask - bid) / ((bid + ask) / 2) * 10000, 6) END AS bps FROM z",
    "holding_days": sql.ctes(TRADES) + "SELECT run, trade_id, greatest(1, CAST(round_even((epoch_us(close) - epoch_us(open)) / 86400000000, 0) AS BIGINT)) AS days FROM trades",
    "open_positions": "WITH p AS (SELECT DISTINCT o_orderpriority AS pair FROM orders UNION ALL SELECT 'none'), o AS (SELECT o_orderpriority AS pair, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS a, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY ALL) SELECT pair, CAST(coalesce(a, 0) AS BIGINT) AS open_amount, d AS oldest_open FROM p LEFT JOIN o USING (pair)",
    "run_stakes": sql.ctes(TRADES) + "SELECT CAST(run AS BIGINT) AS run, trade_id, CASE WHEN run < 7 THEN round(0.001::DOUBLE * run, 6) END AS fee, round(least(1000, greatest(250.0::DOUBLE, (trade_id % 13) / 10.0::DOUBLE * 1000)), 6) AS stake FROM trades",
    "entry_stakes": sql.ctes(BARS, views.ENTRIES, sql.VOL, "f AS (SELECT pair, date, CASE WHEN sigma IS NULL THEN NULL WHEN sigma <= 0 THEN 0.25::DOUBLE ELSE least(1, greatest(0.25::DOUBLE, 0.4::DOUBLE / (2 * sigma))) END AS fraction FROM vol)",
        "e AS (SELECT pair, trade_id, CASE WHEN trade_id % 2 = 0 THEN open_date ELSE date_trunc('hour', open_date) END AS at_, 100.0::DOUBLE + trade_id % 9 * 50 AS proposed, CASE WHEN trade_id % 3 <> 0 THEN 90.0::DOUBLE END AS least_, 260.0::DOUBLE AS most_ FROM entries)",
        "j AS (SELECT e.*, coalesce(f.fraction, 0.25) AS fraction FROM e ASOF LEFT JOIN f ON f.pair = e.pair AND f.date < e.at_)")
    + "SELECT pair, trade_id, at_ AS at, proposed, least_ AS least, most_ AS most, round(fraction, 6) AS fraction, round(least(most_, greatest(proposed * fraction, coalesce(least_, 0))), 6) AS stake FROM j",
    "daily_growth": sql.ctes(DAILY, sql.DAYR, "g AS (SELECT run, count(r) AS days, avg(r) * 36500 AS mean, avg(ln(1 + r)) * 36500 AS growth, ln(1 + avg(r)) * 36500 AS log_mean FROM dr GROUP BY run)", "y AS (SELECT run, datediff('day', min(date), max(date)) / 365.0::DOUBLE AS years FROM daily GROUP BY run)")
    + "SELECT run, days, round(years, 4) AS years, round(mean, 4) AS mean, round(growth, 4) AS growth, round(log_mean, 4) AS log_mean, round(mean - growth, 4) AS gap, round(log_mean - growth, 4) AS drag FROM g JOIN y USING (run)",
    "kelly_report": sql.ctes(TRADES, "t AS (SELECT run, return_pct / 100 AS r FROM trades)", *[f"{n} AS (SELECT run, arg_max(f, (g, -k)) AS {n} FROM (SELECT run, k, k * ({m}::DOUBLE / 400) AS f, round(avg(CASE WHEN 1 + k * ({m}::DOUBLE / 400) * r <= 0 THEN -1e12 ELSE ln(1 + k * ({m}::DOUBLE / 400) * r) END), 9) AS g FROM t, range(401) q(k) GROUP BY run, k) GROUP BY run)" for n, m in (("kelly", "1.0"), ("kelly_wide", "5.0"))],
        "c AS (SELECT run, count(*) AS n, " + ", ".join(f"CASE WHEN NOT bool_or(1 + {f} * r <= 0) THEN round(100 * avg(CASE WHEN 1 + {f} * r > 0 THEN ln(1 + {f} * r) END), 4) END AS growth_{int(100 * f)}" for f in (0.25, 0.5, 0.75, 1.0)) + " FROM t GROUP BY run)",
        "bt AS (SELECT run, return_pct / 100 AS r, row_number() OVER (PARTITION BY run ORDER BY open, trade_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS m FROM trades)", "bd AS (SELECT run, rep, ((rep * m + i) * 1103515245 + 12345) % 2147483648 % m AS i FROM bt, range(50) q(rep))",
        "bg AS (SELECT run, rep, k, round(sum(CASE WHEN 1 + k * 0.05::DOUBLE * r <= 0 THEN -1e12 ELSE ln(1 + k * 0.05::DOUBLE * r) END), 7) AS g FROM bd JOIN bt USING (run, i), range(21) q(k) GROUP BY run, rep, k)", "bb AS (SELECT run, rep, arg_max(k, (g, -k)) * 0.05::DOUBLE AS f FROM bg GROUP BY run, rep)",
        "spread AS (SELECT run, quantile_cont(f, 0.05) AS kelly_p5, quantile_cont(f, 0.5) AS kelly_p50, quantile_cont(f, 0.95) AS kelly_p95, avg(CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_zero FROM bb GROUP BY run)")
    + "SELECT run, n, " + ", ".join(f"CASE WHEN n >= 2 THEN {c} END AS {c}" for c in ("growth_25", "growth_50", "growth_75", "growth_100")) + ", CASE WHEN n >= 2 THEN round(kelly, 4) END AS kelly, CASE WHEN n >= 2 THEN round(kelly_wide, 4) END AS kelly_wide, " + ", ".join(f"CASE WHEN n >= 2 THEN round({c}, 4) END AS {c}" for c in ("kelly_p5", "kelly_p50", "kelly_p95", "share_zero")) + " FROM c JOIN kelly USING (run) JOIN kelly_wide USING (run) JOIN spread USING (run)",
    "key_sets": sql.ctes(BARS, views.FEED_B) + "SELECT pair, date, 'a' AS side FROM (SELECT pair, date FROM bars EXCEPT SELECT pair, date FROM feed_b) UNION ALL SELECT pair, date, 'b' FROM (SELECT pair, date FROM feed_b EXCEPT SELECT pair, date FROM bars)",
    "latest_values": sql.ctes(BARS, CANDIDATES, ASSESSMENTS) + "SELECT candidate_id, arg_max(available_at, line) FILTER (available_at IS NOT NULL) AS available_at, arg_max(decision, line) AS decision FROM assessments GROUP BY candidate_id",
    "gap_whitelist": sql.ctes(BARS, views.FEED_B, "g AS (SELECT pair, date AS after, lead(date) OVER (PARTITION BY pair ORDER BY date) AS before FROM feed_b)") + "SELECT * FROM g WHERE before > after + INTERVAL 1 HOUR AND day(after) % 2 <> 0",
    "manifest_check": "SELECT CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 10 WHEN 3 THEN 'not listed' ELSE 'other digest' END AS error FROM documents WHERE doc_id % 10 IN (3, 4) UNION ALL SELECT 'gone', 'missing'",
    "unseen_left": sql.ctes(BARS, CANDIDATES, ASSESSMENTS) + f"SELECT candidate_id, pair, signal_time FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM assessments WHERE available_at < '{HORIZON}')",
}

@views.candles_once
def decision_rule(spark, d):
    """Four rules on paper trades: the second half of the window at their own fees and at stressed ones, the first half as validation."""
    b, t = views.bars(spark, d), forward.normalised(views.paper_trades(spark, d), NOTIONAL)
    late, early = t.where(F.col("open_date") >= at(MIDDLE)), t.where(F.col("open_date") < at(MIDDLE))
    base, stress, first = (forward.marked(forward.marking_frame(x, b), b, NOTIONAL) for x in (late, forward.at_cost(late, forward.STRESS), early))
    hold = risk.buy_and_hold(b, forward.ASSUMED).select("pair", F.col("max_drawdown_pct").alias("hold_drawdown_pct"))
    runs = base.join(stress.select("pair", F.col("net_return_pct").alias("stress_pct")), "pair").join(first.select("pair", F.col("net_return_pct").alias("validation_pct")), "pair").join(hold, "pair")
    runs = runs.select(F.col("pair").alias("run"), F.col("net_return_pct").alias("net_pct"), "stress_pct", "validation_pct", F.col("mtm_max_drawdown_pct").alias("drawdown_pct"), "hold_drawdown_pct")
    return rounded(rules.decision(rounded(runs, 4)), 3)


def _part(name: str, text: str, cte: str, digits: int) -> str:
    """A registered query's SQL over other rows of the same name, without its rounding to so many digits: the parts of an assessment are rounded alike."""
    body = text.removeprefix("WITH " + cte + ", ")
    if body == text:
        raise ValueError(name)
    body = body.replace(f" + 1e-9, {digits}) AS", ", 12) AS").replace(f", {digits}) AS", ", 12) AS").replace(f", {digits}) END AS", ", 12) END AS")
    return f"{name} AS (WITH {body})"


def _assessment_sql() -> str:
    own = sql.ALL
    parts = {
        "trades": _part("p_trades", own["trade_stats"], TRADES, 4), "mean": _part("p_mean", own["bootstrap_lcg"], TRADES, 6), "top": _part("p_top", own["concentration"], TRADES, 4), "power": _part("p_power", own["power"], TRADES, 4),
        "kelly": _part("p_kelly", SQL["kelly_report"], TRADES, 4), "daily": _part("p_daily", own["sharpe_sortino"], DAILY, 6), "hold": _part("p_hold", own["sharpe_sortino"].replace("strategy / lag(strategy)", "buy_hold / lag(buy_hold)"), DAILY, 6),
        "market": _part("p_market", own["beta_corr"], DAILY, 6), "sharpe": _part("p_sharpe", own["block_bootstrap_lcg"].replace("ceil(n / 20)", "ceil(n / 5)").replace("i // 20", "i // 5").replace("i % 20", "i % 5").replace("n >= 40", "n >= 10"), DAILY, 6),
        "risk": _part("p_risk", own["underwater"].replace("150000", "1000"), DAILY, 4), "growth": _part("p_growth", SQL["daily_growth"], DAILY, 4),
    }
    kinds = {
        "trades": "count:i winners:i win_rate_pct mean_pct sd_pct t_stat sum_pct profit_factor mean_win_pct mean_loss_pct payoff_ratio top2_pp rest_pp median_holding_days mean_holding_days exit_exit_signal:i exit_force_exit:i exit_stop_loss:i longest_losing_streak:i",
        "mean": "low high p_mean_le_zero", "top": "trades:i top_winners:i sum_pp top_two_pp without_top_two_pp", "power": "trades_needed:i trades_per_year years_needed", "kelly": "n:i growth_25 growth_50 growth_75 growth_100 kelly kelly_wide kelly_p5 kelly_p50 kelly_p95 share_zero",
        "daily": "volatility_pct sharpe sortino", "hold": "volatility_pct sharpe sortino", "market": "beta correlation", "sharpe": "low high p_sharpe_le_zero", "risk": "return_pct max_drawdown_pct current_drawdown_pct longest_underwater_days:i current_underwater_days:i", "growth": "days:i years mean growth log_mean gap drag",
    }
    shown = [f"p_{k}.{c[:-2]} AS {k}_{c[:-2]}" if c.endswith(":i") else f"round(p_{k}.{c} + 1e-9, 4) AS {k}_{c}" for k, cs in kinds.items() for c in cs.split()]
    joins = " ".join(f"LEFT JOIN p_{k} ON p_{k}.run = r.run" for k in parts)
    return sql.ctes(
        *_BASE, PERFORMANCE, "trades AS (SELECT pair AS run, trade_id, open_date AS open, close_date AS close, 100 * profit_ratio AS return_pct, coalesce(exit_reason, 'unknown') AS exit FROM acting WHERE close_date IS NOT NULL AND profit_ratio IS NOT NULL)",
        "worths AS (SELECT pair, date, 1000 / 1.005::DOUBLE / first(open) OVER o * close * 0.995::DOUBLE AS worth FROM bars WINDOW o AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING))",
        "daily AS (SELECT e.pair AS run, CAST(e.date AS DATE) AS date, round(arg_max(equity, e.date), 6) AS strategy, round(arg_max(worth, e.date), 6) AS buy_hold FROM run_e e JOIN worths w ON w.pair = e.pair AND w.date = e.date GROUP BY ALL)",
        *parts.values(),
    ) + f"SELECT r.run, {', '.join(shown)} FROM (SELECT DISTINCT run FROM daily) r {joins}"


SQL["run_assessment"] = _assessment_sql()
SQL["decision_rule"] = (
    sql.ctes(
        BARS, PAPER, FRAME, sql.HOLD, f"late AS (SELECT * FROM paper WHERE open_date >= '{MIDDLE}')", f"early AS (SELECT * FROM paper WHERE open_date < '{MIDDLE}')",
        "costly AS (SELECT * REPLACE (0.01::DOUBLE AS fee_open, CASE WHEN close_date IS NOT NULL THEN 0.01::DOUBLE END AS fee_close, CASE WHEN close_date IS NOT NULL THEN amount * close_rate * 0.99::DOUBLE - amount * open_rate * 1.01::DOUBLE END AS profit_abs) FROM late)",
        _frame_sql("late", "lf"), _marked_sql("lf", "lm"), _frame_sql("costly", "cf"), _marked_sql("cf", "cm"), _frame_sql("early", "ef"), _marked_sql("ef", "em"),
        "x AS (SELECT lm.pair, round(lm.net_return_pct, 4) AS net, round(cm.net_return_pct, 4) AS stress, round(em.net_return_pct, 4) AS val, round(lm.mtm_max_drawdown_pct, 4) AS dd, round(hold.max_drawdown_pct, 4) AS hold FROM lm JOIN cm USING (pair) JOIN em USING (pair) JOIN hold USING (pair))",
        "c AS (SELECT pair, 'K1' AS criterion, round(net, 4) AS margin, net > 0 AS passes FROM x UNION ALL SELECT pair, 'K2', round(0.6::DOUBLE * hold - dd, 4), 0.6::DOUBLE * hold - dd >= 0 FROM x UNION ALL SELECT pair, 'K3', round(stress, 4), stress > 0 FROM x UNION ALL SELECT pair, 'K4', round(val, 4), val > 0 FROM x)",
    )
    + "SELECT pair AS run, criterion, round(margin, 3) AS margin, passes, CASE WHEN bool_and(passes) OVER (PARTITION BY pair) THEN 'GO' ELSE 'NO-GO' END AS verdict, first(criterion) OVER (PARTITION BY pair ORDER BY margin, criterion ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS binding FROM c"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: globals()[k] for k in SQL}
