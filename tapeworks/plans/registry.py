"""All registered queries. Each reads its tables under sf_dir and returns one result; sql.py has the DuckDB form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.columns import rounded
from tapeworks.operators import candles as cd
from tapeworks.operators import matching, normal, resample, risk, rules, structure, trades
from tapeworks.operators import simulate as sim
from tapeworks.sources import views

from . import judged, sql, studies

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
PAIR, RUN = ["pair"], ["run"]
INITIAL, FEE = 1000.0, 0.001
GROUND = 150_000.0  # capital that the daily series start from


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


@query
def candles_bars(spark, d):
    return rounded(views.bars(spark, d))


@query
def candle_contract(spark, d):
    return cd.candle_violations(views.bars(spark, d))


@query
def closed_filter(spark, d):
    now = F.lit("2024-01-20 12:30:00").cast("timestamp_ntz")
    return cd.closed(views.bars(spark, d), now).groupBy("pair").agg(F.count("*").alias("closed"), F.max("date").alias("last"))


@query
def log_returns_open(spark, d):
    return rounded(cd.log_returns_from_open(views.bars(spark, d)))


@query
def log_returns_close(spark, d):
    return rounded(cd.log_returns(views.bars(spark, d)))


@query
def simple_returns(spark, d):
    return rounded(risk_returns(spark, d).select("run", "date", "r"))


def risk_returns(spark: SparkSession, d: str) -> DataFrame:
    return cd.simple_returns(views.daily(spark, d), RUN, "strategy")


@query
def wick_ratios(spark, d):
    return rounded(cd.wick_ratios(views.bars(spark, d)))


@query
def channels(spark, d):
    return rounded(cd.channels(views.bars(spark, d)).select("pair", "date", "entry_high", "exit_low"))


@query
def signals(spark, d):
    return cd.signals(views.bars(spark, d)).select("pair", "date", "enter", "exit")


@query
def realized_vol(spark, d):
    return rounded(cd.realized_volatility(views.bars(spark, d)))


@query
def vol_target_fraction(spark, d):
    v = cd.realized_volatility(views.bars(spark, d))
    return rounded(v.select("pair", "date", cd.target_fraction(F.col("sigma")).alias("fraction")))


@query
def drawdown_series(spark, d):
    return rounded(risk.drawdowns(views.bars(spark, d), PAIR, "close").select("pair", "date", "peak", "drawdown_pct"))


@query
def daily_marks(spark, d):
    return rounded(risk.daily_marks(views.bars(spark, d), PAIR, "close"))


@query
def underwater(spark, d):
    return rounded(risk.underwater(views.daily(spark, d), RUN, "strategy", GROUND), 4)


@query
def longest_drawdown_marks(spark, d):
    return risk.longest_drawdown_marks(views.daily(spark, d), RUN, "strategy")


@query
def losing_streak(spark, d):
    return trades.losing_streak(views.trades(spark, d))


@query
def yearly_returns(spark, d):
    return rounded(risk.yearly_returns(views.daily(spark, d), RUN), 4)


@query
def monthly_returns(spark, d):
    return rounded(risk.monthly_returns(views.daily(spark, d), RUN, GROUND), 4)


@query
def moments(spark, d):
    return rounded(risk.moments(cd.log_returns(views.bars(spark, d)), PAIR, 24 * 365))


@query
def sharpe_sortino(spark, d):
    return rounded(risk.ratios(risk_returns(spark, d), RUN))


@query
def beta_corr(spark, d):
    v = cd.simple_returns(views.daily(spark, d), RUN, "strategy").drop("buy_hold")
    b = cd.simple_returns(views.daily(spark, d), RUN, "buy_hold").select("run", "date", F.col("r").alias("b"))
    return rounded(risk.beta_and_correlation(v.join(b, ["run", "date"]), RUN))


@query
def trade_stats(spark, d):
    t = trades.trade_statistics(views.trades(spark, d))
    return rounded(t.select(*[(F.col(c) + 1e-9).alias(c) if k == "double" else c for c, k in t.dtypes]), 4)  # off the ties


@query
def exit_histogram(spark, d):
    return trades.exit_histogram(views.trades(spark, d))


@query
def exposure(spark, d):
    bounds = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-25 00:00:00")]
    return rounded(trades.exposure(views.trades(spark, d), *bounds))


@query
def buy_hold(spark, d):
    return rounded(risk.buy_and_hold(views.bars(spark, d), FEE), 4)


@query
def forward_benchmark(spark, d):
    return rounded(risk.forward_benchmark(views.bars(spark, d), INITIAL, FEE))


@query
def hill_tail(spark, d):
    return rounded(structure.hill_tail(risk_returns(spark, d), RUN), 4)


@query
def acf(spark, d):
    return rounded(structure.acf(cd.log_returns(views.bars(spark, d)), PAIR, [1, 2, 5, 10, 24]))


@query
def mrw_fit(spark, d):
    return rounded(structure.intermittency(risk_returns(spark, d), RUN, 40), 4)


@query
def dfa_hurst(spark, d):
    return rounded(structure.dfa(cd.log_returns(views.bars(spark, d)), PAIR, structure.scales(400)))


@query
def perm_entropy(spark, d):
    return rounded(structure.permutation_entropy(cd.log_returns(views.bars(spark, d)), PAIR))


@query
def garch_filter_fixed(spark, d):
    v = structure.garch_variance(cd.log_returns(views.bars(spark, d)), PAIR, 1e-6, 0.1, 0.85)
    return rounded(v.select("pair", "date", (1e6 * F.col("variance")).alias("variance_e6")), 4)


@query
def trade_growth(spark, d):
    return rounded(trades.trade_growth(views.trades(spark, d)), 9)


@query
def kelly_grid(spark, d):
    return rounded(trades.kelly(views.trades(spark, d)))


@query
def frontier(spark, d):
    return rounded(trades.frontier(views.daily(spark, d), RUN, [0.25, 0.5, 1.0], 10 * GROUND), 4)


@query
def constant_exposure(spark, d):
    return rounded(trades.constant_exposure(views.daily(spark, d), RUN, 0.05, FEE, INITIAL), 1)


@query
def power(spark, d):
    return rounded(trades.power(views.trades(spark, d), 2.0), 4)


@query
def concentration(spark, d):
    return rounded(trades.concentration(views.trades(spark, d)), 4)


@query
def sleeves(spark, d):
    return rounded(trades.sleeves(views.daily(spark, d), RUN, [0.25, 0.5, 1.0], GROUND, 5.0), 3)


@query
def feed_compare(spark, d):
    return rounded(matching.feed_passes(matching.compare_feeds(views.bars(spark, d), views.feed_b(spark, d))))


@query
def asof_match(spark, d):
    return matching.match_trades(views.entries(spark, d), views.assessments(spark, d), 3.0, 180.0)


@query
def reason_counts(spark, d):
    m = matching.match_trades(views.entries(spark, d), views.assessments(spark, d), 3.0)
    return m.groupBy("pair", "reason").agg(F.count("*").alias("n"))


@query
def latest_per_key(spark, d):
    return matching.latest_assessments(views.assessments(spark, d)).select("candidate_id", "decision", "available_at", "line")


@query
def unseen_anti(spark, d):
    seen = views.assessments(spark, d).where("decision = 'approve'")
    return matching.unseen(views.candidates(spark, d), seen).select("candidate_id", "pair", "signal_time")


@query
def reference_open(spark, d):
    return rounded(matching.reference_open(views.entries(spark, d).drop("open", "close"), views.feed_b(spark, d)))


@query
def execution_report(spark, d):
    e = views.entries(spark, d).withColumn("open", F.col("open") * (1 + (F.col("trade_id") % 7) / 10000.0))
    return rounded(matching.execution_report(e, views.bars(spark, d), FEE), 4)


@query
def vol_lookup(spark, d):
    v = cd.realized_volatility(views.bars(spark, d))
    return rounded(matching.sized_by_volatility(views.entries(spark, d).drop("open", "close"), v))


@query
def signal_entry_match(spark, d):
    return matching.signal_entries(cd.signals(views.bars(spark, d)), views.entries(spark, d)).select("pair", "trade_id", "signal_time")


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    return sim.simulate(views.bars(spark, d), PAIR, sim.Rules(), FEE, INITIAL)


@query
def simulate(spark, d):
    return rounded(_simulated(spark, d))


@query
def in_position(spark, d):
    return matching.in_position(cd.signals(views.bars(spark, d)), _simulated(spark, d))


@query
def mtm_equity(spark, d):
    return rounded(sim.mark_to_market(_simulated(spark, d), views.bars(spark, d), PAIR, INITIAL, FEE), 4)


@query
def backtest_summary(spark, d):
    t, b = _simulated(spark, d), views.bars(spark, d)
    return rounded(sim.summary(t, sim.mark_to_market(t, b, PAIR, INITIAL, FEE), PAIR, INITIAL), 4)


@query
def order_rollup(spark, d):
    return matching.order_rollup(views.table(spark, d, "lineitem"))


@query
def order_counts(spark, d):
    return views.table(spark, d, "orders").groupBy(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query
def reconcile(spark, d):
    return matching.reconcile(*views.books(spark, d), F.lit("BTC"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))


@query
def archive_merge(spark, d):
    return rounded(cd.archive_merge(views.feed_b(spark, d), views.bars(spark, d), ["pair", "date"]))


@query
def archive_revisions(spark, d):
    bad = cd.check_immutable(views.bars(spark, d), views.feed_b(spark, d), ["pair", "date"], ["open", "close"])
    return bad.groupBy("pair").agg(F.count("*").alias("revised"))


@query
def bootstrap_lcg(spark, d):
    return rounded(resample.bootstrap_mean(views.trades(spark, d), RUN, "return_pct", ["open", "trade_id"], 200))


@query
def block_bootstrap_lcg(spark, d):
    return rounded(resample.block_bootstrap_sharpe(risk_returns(spark, d), RUN, 20, 50))


@query
def kelly_bootstrap_lcg(spark, d):
    return rounded(resample.kelly_bootstrap(views.trades(spark, d), 50))


@query
def block_shuffle_lcg(spark, d):
    return rounded(resample.block_shuffle(cd.log_returns(views.bars(spark, d)), PAIR, 30))


@query
def order_feasibility(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 97).cast("double").alias("stake"), F.round("o_totalprice", 2).alias("price"))
    return rounded(rules.feasibility(o, 1e-4, 0.004, 2e-4, 10.0, -0.2))


@query
def candidate_ids(spark, d):
    at = F.date_format(F.col("signal_time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return views.candidates(spark, d).select("candidate_id", rules.candidate_id(F.lit("walk"), F.col("pair"), at, F.lit("v1")).alias("sha"))


@query
def redact(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2(rules.redacted(F.col("text")), 256).alias("redacted_sha"))


def _daily_log_returns(spark: SparkSession, d: str) -> DataFrame:
    r = F.ln(F.col("strategy") / F.lag("strategy").over(cd.ordered(RUN)))
    return views.daily(spark, d).withColumn("r", r).where("r is not null")


@query
def deflated_sharpe(spark, d):
    """Each run against the best Sharpe ratio that as many runs without skill would show."""
    m = risk.moments(_daily_log_returns(spark, d), RUN, 365).select("run", "n", (F.col("mean") / F.col("sd")).alias("sharpe"), "skewness", "excess_kurtosis")
    v, k, g = F.var_samp("sharpe"), F.count("*").cast("double"), 0.5772156649015329
    best = m.agg(v.alias("v"), k.alias("k"))  # one row
    best = best.select(F.sqrt("v").alias("root"), *[normal.normal_quantile(p).alias(c) for c, p in (("z1", 1 - 1 / F.col("k")), ("z2", 1 - 1 / (F.col("k") * math.e)))])
    best = best.select(F.lit(1).alias("one"), (F.col("root") * ((1 - g) * F.col("z1") + g * F.col("z2"))).alias("benchmark"))
    b = m.withColumn("one", F.lit(1)).join(F.broadcast(best), "one").drop("one")
    p = normal.deflated_sharpe(F.col("sharpe"), F.col("benchmark"), F.col("n"), F.col("skewness"), F.col("excess_kurtosis"))
    return rounded(b.select("run", "sharpe", "benchmark", p.alias("probability")), 5)


@query
def stop_probability(spark, d):
    """The chance of a 20 % fall within 30 days at the volatility of each candle, with a drift of 0.1 a year."""
    v = cd.realized_volatility(views.bars(spark, d))
    return rounded(v.select("pair", "date", normal.stop_hit_probability(F.col("sigma"), 30, drift=0.1).alias("probability")), 5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to candles, signals, paper trades marked at each candle, and one row of performance a pair."""
    return judged.forward_performance(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _ALL | judged.QUERIES | studies.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ALL.items() if k in _ALL} | judged.SQL | studies.SQL
