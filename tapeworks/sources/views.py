"""Market tables derived from the test tables, so that every query has rows and an independent SQL form.

ticks/bars: a price walk of 0.2 % steps for each event type (pair) and its hourly candles. feed_b: the same candles from a
second source. daily: an equity curve and a benchmark for each order priority (run). trades: consecutive purchases of a user.
candidates, assessments: signups and clicks. db_orders, exchange_orders: orders as two books that disagree in places.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import hour_of
from tapeworks.functions.written import written
from tapeworks.operators.running import running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, ts, event_id, px."""
    step = F.when(F.col("value") > 34.5, 1).otherwise(-1)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("pair"), "ts", "event_id", step.alias("step"), hour_of("ts").alias("hour"))
    walk = running_sum(events, ["pair"], "hour", ["ts", "event_id"], "step", "level")
    return walk.select("pair", "ts", "event_id", "hour", F.round(1000 * F.exp(0.002 * F.col("level")), 6).alias("px"))


#: Candles written for the query that is being put together, by folder; None where each use works them out.
_once: ContextVar[dict[str, DataFrame] | None] = ContextVar("once", default=None)


def candles_once(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with its candles written once for all its uses of them."""

    @wraps(query)
    def own(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _once.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _once.reset(token)

    return own


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, date, open, high, low, close, volume: hourly candles; hours without a tick are gaps."""
    kept = _once.get()
    if kept is None:
        return _bars(spark, sf_dir)
    if sf_dir not in kept:
        kept[sf_dir] = written(_bars(spark, sf_dir), "candles")
    return kept[sf_dir]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("pair", F.col("hour").alias("date")).agg(
        F.min_by("px", "ts").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


BARS = """
ticks AS (
  SELECT event_type AS pair, ts, event_id, round(1000 * exp(0.002 * sum(CASE WHEN value > 34.5 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS px FROM events
), bars AS (
  SELECT pair, date_trunc('hour', ts) AS date, arg_min(px, ts) AS open, max(px) AS high, min(px) AS low, arg_max(px, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY ALL
)"""


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second feed of the candles: closes off by up to 15 basis points, every 7th hour missing."""
    hour = F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / 3600)
    off = (F.pmod(hour * 7919, F.lit(31)) - 15) / 10000.0
    return bars(spark, sf_dir).where(F.pmod(hour, F.lit(7)) != 0).withColumn("close", F.round(F.col("close") * (1 + off), 6))


FEED_B = """
feed_b AS (
  SELECT pair, date, open, high, low, round(close * (1 + ((CAST(epoch(date) AS BIGINT) // 3600) * 7919 % 31 - 15) / 10000.0::DOUBLE), 6) AS close, volume FROM bars WHERE (CAST(epoch(date) AS BIGINT) // 3600) % 7 <> 0
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, date, strategy, buy_hold: the mean order of the run's priority, and of all, on each day; cents are summed exactly."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    own = orders.groupBy("run", "date").agg((F.sum("cents") / 100.0 / F.count("*")).alias("strategy"))
    every = orders.groupBy("date").agg((F.sum("cents") / 100.0 / F.count("*")).alias("buy_hold"))
    return own.join(every, "date").select("run", "date", F.round("strategy", 4).alias("strategy"), F.round("buy_hold", 4).alias("buy_hold"))


DAILY = """
cents AS (SELECT o_orderpriority AS run, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
own AS (SELECT run, date, round(sum(cents) / 100.0::DOUBLE / count(*), 4) AS strategy FROM cents GROUP BY ALL),
every AS (SELECT date, round(sum(cents) / 100.0::DOUBLE / count(*), 4) AS buy_hold FROM cents GROUP BY ALL),
daily AS (SELECT run, date, strategy, buy_hold FROM own JOIN every USING (date))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, trade_id, open, close, return_pct, exit: a user's 1st and 2nd, 3rd and 4th, ... purchase open and close a trade; later runs earn less."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    buys = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 0))
    rows = buys.select("user_id", "event_id", "ts", "value", F.row_number().over(w).alias("n"), F.lead("ts").over(w).alias("close"), F.lead("value").over(w).alias("last"))
    rows = rows.where((F.col("n") % 2 == 1) & F.col("close").isNotNull())
    exit_ = F.element_at(F.array(F.lit("exit_signal"), F.lit("stop_loss"), F.lit("force_exit")), (F.col("event_id") % 3 + 1).cast("int"))
    pct = F.round(F.least(F.greatest((F.col("last") / F.col("value") - 1) * 10, F.lit(-60.0)), F.lit(60.0)) - 4.0 * (F.col("user_id") % 8), 4)
    return rows.select((F.col("user_id") % 8).alias("run"), F.col("event_id").alias("trade_id"), F.col("ts").alias("open"), "close", pct.alias("return_pct"), exit_.alias("exit"))


TRADES = """
buys AS (
  SELECT user_id, event_id, ts, value, row_number() OVER w AS n, lead(ts) OVER w AS close, lead(value) OVER w AS last
  FROM events WHERE event_type = 'purchase' AND value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), trades AS (
  SELECT user_id % 8 AS run, event_id AS trade_id, ts AS open, close, round(least(greatest((last / value - 1) * 10, -60.0::DOUBLE), 60.0::DOUBLE) - 4.0::DOUBLE * (user_id % 8), 4) AS return_pct,
    ['exit_signal', 'stop_loss', 'force_exit'][event_id % 3 + 1] AS exit
  FROM buys WHERE n % 2 = 1 AND close IS NOT NULL
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, pair, signal_time: every third hour of each pair."""
    b = bars(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("pair").orderBy("date"))
    named = b.withColumn("seq", seq).where(F.col("seq") % 3 == 0)
    return named.select(F.concat_ws("-", "pair", F.col("seq").cast("string")).alias("candidate_id"), "pair", F.col("date").alias("signal_time"), F.col("seq").cast("long").alias("seq"))


CANDIDATES = """
numbered AS (SELECT pair, date, row_number() OVER (PARTITION BY pair ORDER BY date) AS seq FROM bars),
candidates AS (SELECT pair || '-' || seq AS candidate_id, pair, date AS signal_time, seq FROM numbered WHERE seq % 3 = 0)"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, pair, signal_time, decision, available_at, line: one to three records a candidate, some without a time, some equally late."""
    c = candidates(spark, sf_dir).withColumn("third", F.expr("seq div 3"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), (F.col("third") % 3).cast("int"))).alias("k"))
    mark = F.col("third") * 5 + F.col("k") * F.when(F.col("third") % 7 == 0, 400).otherwise(7)
    late = F.when(mark % 11 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("signal_time") + F.make_dt_interval(mins=((mark * 37) % 400).cast("int")))
    decision = F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("abstain")), (mark % 3 + 1).cast("int"))
    return c.select("candidate_id", "pair", "signal_time", decision.alias("decision"), late.alias("available_at"), (F.col("seq") * 10 + F.col("k")).alias("line"))


ASSESSMENTS = """
repeated AS (SELECT *, seq // 3 AS third, unnest(range(0, seq // 3 % 3 + 1)) AS k FROM candidates),
marked AS (SELECT *, third * 5 + k * CASE WHEN third % 7 = 0 THEN 400 ELSE 7 END AS mark FROM repeated),
assessments AS (
  SELECT candidate_id, pair, signal_time, ['approve', 'reject', 'abstain'][mark % 3 + 1] AS decision,
    CASE WHEN mark % 11 = 0 THEN NULL ELSE signal_time + to_minutes((mark * 37) % 400) END AS available_at, seq * 10 + k AS line FROM marked
)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, trade_id, open_date: an entry 25 minutes after every fifth candle's start."""
    seq = F.row_number().over(Window.partitionBy("pair").orderBy("date"))
    rows = bars(spark, sf_dir).withColumn("seq", seq).where(F.col("seq") % 5 == 0)
    return rows.select("pair", F.col("seq").cast("long").alias("trade_id"), (F.col("date") + F.make_dt_interval(mins=F.lit(25))).alias("open_date"), "open", "close")


ENTRIES = """
entry_rows AS (SELECT pair, date, open, close, row_number() OVER (PARTITION BY pair ORDER BY date) AS seq FROM bars),
entries AS (SELECT pair, seq AS trade_id, date + INTERVAL 25 MINUTE AS open_date, open, close FROM entry_rows WHERE seq % 5 = 0)"""


def books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two books of orders (see matching.reconcile) that disagree in places, by o_orderkey % 20.

    1 is not in the first, 2 and 13 not in the second, 3 has another amount, 4 another fee, 8 another fee in another currency, 5
    is open in the first only, 6 and 7 are open and canceled in the second, 9 has no fee there; 10 is twice in the first, with
    the right amount in the later line, 12 twice in the second with a wrong one.
    """
    k, order = F.col("k"), F.col("order_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.round("o_totalprice", 2).alias("amount"), (F.col("o_orderkey") % 20).alias("k"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("order_date"))
    fee = F.round(F.col("amount") * 0.004, 6)
    lines = lambda twice: F.explode(F.when(k == twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    off = (k == 3) | ((k == 10) & (F.col("copy") == 0))
    db = o.where("k <> 1").select("*", lines(10)).select("order_id", F.when(off, F.col("amount") + 1).otherwise(F.col("amount")).alias("filled"), fee.alias("fee_base"), k.isin(5, 2, 7).alias("is_open"), "order_date", (order * 2 + F.col("copy")).alias("line"))
    status = F.when(k == 6, "open").when(k == 7, "canceled").otherwise("closed")
    exchange = o.where("k not in (2, 13)").select("*", lines(12)).select("order_id", F.when(k == 12, F.col("amount") - 1).otherwise(F.col("amount")).alias("filled"), status.alias("status"), F.when(k.isin(4, 8), fee * 2).when(k != 9, fee).alias("fee_cost"), F.when(k == 8, "EUR").otherwise("BTC").alias("fee_currency"), (order * 2 + F.col("copy")).alias("line"))
    return db, exchange


BOOKS = """
keyed AS (SELECT o_orderkey AS order_id, round(o_totalprice, 2) AS amount, o_orderkey % 20 AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS order_date FROM orders),
db AS (SELECT order_id, CASE WHEN k = 3 OR k = 10 AND copy = 0 THEN amount + 1 ELSE amount END AS filled, round(amount * 0.004::DOUBLE, 6) AS fee_base, k IN (5, 2, 7) AS is_open, order_date, order_id * 2 + copy AS line FROM (SELECT *, unnest(CASE WHEN k = 10 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE k <> 1)),
exchange AS (SELECT order_id, CASE WHEN k = 12 THEN amount - 1 ELSE amount END AS filled, CASE k WHEN 6 THEN 'open' WHEN 7 THEN 'canceled' ELSE 'closed' END AS status, CASE WHEN k IN (4, 8) THEN round(amount * 0.004::DOUBLE, 6) * 2 WHEN k <> 9 THEN round(amount * 0.004::DOUBLE, 6) END AS fee_cost,
  CASE WHEN k = 8 THEN 'EUR' ELSE 'BTC' END AS fee_currency, order_id * 2 + copy AS line FROM (SELECT *, unnest(CASE WHEN k = 12 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE k NOT IN (2, 13)))"""


def paper_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper trade at every fifth candle, closed three candles later; the last may be open. See operators/forward.py.

    Pairs differ: view trades at every fiftieth candle only, purchase pays too much at the entry, error and signup get more at the exit.
    """
    w = Window.partitionBy("pair").orderBy("date")
    b = bars(spark, sf_dir).select("pair", "date", "open", F.row_number().over(w).alias("seq"), F.lead("date", 3).over(w).alias("to_date"), F.lead("open", 3).over(w).alias("to_open"))
    pair = F.col("pair")
    t = b.where(F.col("seq") % F.when(pair == "view", 50).otherwise(5) == 0).withColumn("j", F.expr("seq div 5"))
    dear, well = F.when(pair == "purchase", 1.02).otherwise(1.0), F.when(pair == "error", 1.02).when(pair == "signup", 1.011).otherwise(1.0)
    t = t.select(
        "pair", F.col("seq").cast("long").alias("trade_id"), "j", F.lit("walk").alias("strategy"), F.lit("1h").alias("timeframe"), F.when(F.col("j") % 2 == 0, F.col("date")).alias("submitted_date"),
        (F.col("date") + F.make_dt_interval(mins=((F.col("j") % 4) * 5).cast("int"))).alias("open_date"), (F.col("to_date") + F.expr("INTERVAL 2 MINUTE")).alias("close_date"),
        (100.0 + F.col("j") % 3 * 50).alias("stake_amount"), F.round(F.col("open") * (1 + (F.col("j") % 7 - 3) / 10000.0) * dear, 6).alias("open_rate"), F.round(F.col("to_open") * (1 - (F.col("j") % 5 - 2) / 10000.0) * well, 6).alias("close_rate"), F.lit(0.004).alias("fee_open"),
        F.when(F.col("to_date").isNotNull(), 0.005).alias("fee_close"), F.when(F.col("to_date").isNotNull(), F.element_at(F.array(F.lit("exit_signal"), F.lit("exit_signal"), F.lit("stop_loss"), F.lit("roi")), (F.col("j") % 4 + 1).cast("int"))).alias("exit_reason"),
    ).withColumn("amount", F.round(F.col("stake_amount") / F.col("open_rate"), 8))
    paid = F.col("amount") * F.col("open_rate") * 1.004
    t = t.withColumn("profit_abs", F.round(F.col("amount") * F.col("close_rate") * 0.995 - paid, 6))
    return t.withColumn("profit_ratio", F.round(F.col("profit_abs") / paid, 8)).drop("j")


PAPER = """
paper_rows AS (SELECT pair, date, open, row_number() OVER w AS seq, lead(date, 3) OVER w AS to_date, lead(open, 3) OVER w AS to_open FROM bars WINDOW w AS (PARTITION BY pair ORDER BY date)),
paper_kept AS (SELECT *, seq // 5 AS j, CASE pair WHEN 'purchase' THEN 1.02::DOUBLE ELSE 1 END AS dear, CASE pair WHEN 'error' THEN 1.02::DOUBLE WHEN 'signup' THEN 1.011::DOUBLE ELSE 1 END AS well FROM paper_rows WHERE seq % CASE pair WHEN 'view' THEN 50 ELSE 5 END = 0),
paper_priced AS (
  SELECT pair, seq AS trade_id, 'walk' AS strategy, '1h' AS timeframe, CASE WHEN j % 2 = 0 THEN date END AS submitted_date, date + to_minutes((j % 4) * 5) AS open_date, to_date + INTERVAL 2 MINUTE AS close_date,
    100.0::DOUBLE + j % 3 * 50 AS stake_amount, round(open * (1 + (j % 7 - 3) / 10000.0::DOUBLE) * dear, 6) AS open_rate, round(to_open * (1 - (j % 5 - 2) / 10000.0::DOUBLE) * well, 6) AS close_rate, 0.004::DOUBLE AS fee_open,
    CASE WHEN to_date IS NOT NULL THEN 0.005::DOUBLE END AS fee_close, CASE WHEN to_date IS NOT NULL THEN ['exit_signal', 'exit_signal', 'stop_loss', 'roi'][j % 4 + 1] END AS exit_reason FROM paper_kept
), paper_sized AS (SELECT *, round(stake_amount / open_rate, 8) AS amount FROM paper_priced),
paper_gain AS (SELECT *, round(amount * close_rate * 0.995::DOUBLE - amount * open_rate * 1.004::DOUBLE, 6) AS profit_abs FROM paper_sized),
paper AS (SELECT *, round(profit_abs / (amount * open_rate * 1.004::DOUBLE), 8) AS profit_ratio FROM paper_gain)"""


def fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trades with the precision of their exchange, and their orders; each number of o_orderkey % 31 up to 20 has a fault or oddity of its own."""
    k, id_ = F.col("k"), F.col("trade_id")
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), F.round(F.col("o_totalprice") / 1000, 3).alias("q"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("day"), (F.col("o_orderkey") % 31).alias("k"))
    mode = F.when(k == 5, 7).when(k == 6, 4).otherwise(2 + id_ % 3)
    digits = F.when(k == 3, None).when(k == 4, -1.0).when(k == 6, 0.0).otherwise(F.when(mode == 2, 3.0).when(mode == 3, 5.0).otherwise(0.001))
    unit = F.when(mode == 3, F.pow(F.lit(10.0), F.floor(F.log10("q")) - 4)).otherwise(0.001)
    amount = F.when(k == 15, F.col("q") + 10 * unit).when(k == 18, F.col("q") + 0.9 * unit).otherwise(F.col("q"))
    open_ = k.isin(12, 17, 19, 20)
    trades = base.select("trade_id", open_.alias("is_open"), amount.alias("amount"), F.col("day").alias("open_date"), digits.alias("digits"), mode.cast("long").alias("mode"))

    def order(side, filled, at, status=F.lit("closed"), pending=F.lit(False), fee=F.lit(0.0), undated=F.lit(False)):
        placed = F.col("day") + F.make_dt_interval(hours=F.lit(at))
        return F.struct(side.alias("side"), status.alias("status"), pending.alias("is_open"), filled.alias("filled"), fee.alias("fee_base"), placed.alias("order_date"), F.when(~undated, placed + F.expr("INTERVAL 5 MINUTE")).alias("filled_date"))

    entry = order(F.lit("buy"), F.when(k == 17, 0.0).otherwise(F.col("q")), 1, F.when(k == 9, "open").when(k == 20, "canceled").otherwise("closed"), k == 8, F.when(k == 7, F.col("q")).otherwise(0.0), k == 10)
    again = order(F.lit("buy"), F.lit(1.0), 2)
    left = order(F.when(id_ % 2 == 1, "stoploss").otherwise("sell"), F.when(k == 16, F.col("q") - 10 * unit).otherwise(amount), 20)
    other = order(F.lit("settle"), F.lit(1.0), 21)
    every = F.array_compact(F.array(entry, F.when(k == 11, again), F.when((~open_ & (k != 13)) | (k == 12), left), F.when(k == 14, other)))
    return trades, base.select("trade_id", F.inline(every))


FILLS = """
fill_base AS (SELECT o_orderkey AS trade_id, round(o_totalprice / 1000, 3) AS q, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, o_orderkey % 31 AS k FROM orders),
fill_modes AS (SELECT *, CAST(CASE WHEN k = 5 THEN 7 WHEN k = 6 THEN 4 ELSE 2 + trade_id % 3 END AS BIGINT) AS mode, k IN (12, 17, 19, 20) AS is_open FROM fill_base),
fill_units AS (SELECT *, CASE WHEN mode = 3 THEN pow(10::DOUBLE, floor(log10(q)) - 4) ELSE 0.001::DOUBLE END AS u FROM fill_modes),
fill_rows AS (SELECT *, CASE WHEN k = 15 THEN q + 10 * u WHEN k = 18 THEN q + 0.9::DOUBLE * u ELSE q END AS amount FROM fill_units),
fill_trades AS (SELECT trade_id, is_open, amount, day AS open_date, CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN -1.0::DOUBLE WHEN k = 6 THEN 0.0::DOUBLE WHEN mode = 2 THEN 3.0::DOUBLE WHEN mode = 3 THEN 5.0::DOUBLE ELSE 0.001::DOUBLE END AS digits, mode FROM fill_rows),
fill_orders AS (
  SELECT trade_id, 'buy' AS side, CASE k WHEN 9 THEN 'open' WHEN 20 THEN 'canceled' ELSE 'closed' END AS status, k = 8 AS is_open, CASE WHEN k = 17 THEN 0.0::DOUBLE ELSE q END AS filled, CASE WHEN k = 7 THEN q ELSE 0.0::DOUBLE END AS fee_base,
    day + INTERVAL 1 HOUR AS order_date, CASE WHEN k <> 10 THEN day + INTERVAL 65 MINUTE END AS filled_date FROM fill_rows
  UNION ALL SELECT trade_id, 'buy', 'closed', false, 1.0, 0.0, day + INTERVAL 2 HOUR, day + INTERVAL 125 MINUTE FROM fill_rows WHERE k = 11
  UNION ALL SELECT trade_id, CASE WHEN trade_id % 2 = 1 THEN 'stoploss' ELSE 'sell' END, 'closed', false, CASE WHEN k = 16 THEN q - 10 * u ELSE amount END, 0.0, day + INTERVAL 20 HOUR, day + INTERVAL 1205 MINUTE FROM fill_rows WHERE (NOT is_open AND k <> 13) OR k = 12
  UNION ALL SELECT trade_id, 'settle', 'closed', false, 1.0, 0.0, day + INTERVAL 21 HOUR, day + INTERVAL 1265 MINUTE FROM fill_rows WHERE k = 14
)"""


def trials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledgers (an order priority each) of six trials over intervals, daily returns of the trials, and of the ledger as a whole.

    A trial's value on a day is the mean order of its priority and part. Ledgers differ: in 2 trials follow each other in time,
    in 3 one is counted, in 4 one never moves, in 5 they overlap; the sixth trial is a benchmark.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ledger"), (F.col("o_orderkey") % 6).alias("id"), F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    no = F.substring("ledger", 1, 1).cast("int")
    marks = o.groupBy("ledger", "id", "date").agg((F.sum("cents") / 100.0 / F.count("*")).alias("v")).withColumn("v", F.when((no == 4) & (F.col("id") == 1), 100.0).otherwise(F.col("v")))
    r = F.round(F.ln(F.col("v") / F.lag("v").over(Window.partitionBy("ledger", "id").orderBy("date"))) / 100, 8)
    returns = marks.withColumn("r", r).where("r is not null").select("ledger", "id", "date", "r")
    shift = F.when(no == 2, 400).when(no == 5, 30).otherwise(0) * F.col("id")
    start = F.date_add(F.lit("1992-01-01").cast("date"), shift.cast("int"))
    rows = o.select("ledger", "id").distinct()
    rows = rows.select("ledger", "id", F.when(F.col("id") == 5, "benchmark").otherwise("trial").alias("kind"), F.when(no == 3, F.col("id") == 0).otherwise(F.col("id") < 5).alias("counted"), start.alias("start"), F.date_add(start, F.when(no == 2, 400).otherwise(2000)).alias("end"))
    day = daily(spark, sf_dir)
    own = F.round(F.ln(F.col("strategy") / F.lag("strategy").over(Window.partitionBy("run").orderBy("date"))) / 100, 8)
    return rows, returns, day.select(F.col("run").alias("ledger"), own.alias("r")).where("r is not null")


TRIALS = DAILY + """,
trial_orders AS (SELECT o_orderpriority AS ledger, o_orderkey % 6 AS id, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(substr(o_orderpriority, 1, 1) AS INT) AS no FROM orders),
trial_marks AS (SELECT ledger, id, date, CASE WHEN no = 4 AND id = 1 THEN 100.0::DOUBLE ELSE sum(cents) / 100.0::DOUBLE / count(*) END AS v FROM trial_orders GROUP BY ledger, id, date, no),
trial_steps AS (SELECT ledger, id, date, round(ln(v / lag(v) OVER (PARTITION BY ledger, id ORDER BY date)) / 100, 8) AS r FROM trial_marks), trial_returns AS (SELECT * FROM trial_steps WHERE r IS NOT NULL),
trial_ids AS (SELECT DISTINCT ledger, id, no, CAST(DATE '1992-01-01' + CAST(CASE no WHEN 2 THEN 400 WHEN 5 THEN 30 ELSE 0 END * id AS INT) AS DATE) AS start FROM trial_orders),
trials AS (SELECT ledger, id, CASE WHEN id = 5 THEN 'benchmark' ELSE 'trial' END AS kind, CASE WHEN no = 3 THEN id = 0 ELSE id < 5 END AS counted, start, CAST(start + CASE WHEN no = 2 THEN 400 ELSE 2000 END AS DATE) AS "end" FROM trial_ids),
observed0 AS (SELECT run AS ledger, round(ln(strategy / lag(strategy) OVER (PARTITION BY run ORDER BY date)) / 100, 8) AS r FROM daily), observed AS (SELECT * FROM observed0 WHERE r IS NOT NULL)"""


def desk_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of daily values, of statistics and of growth, one of each a customer; customers differ in what is wrong with them.

    A customer's days begin at the first order and are three an order; values swing with the sum of the orders.
    """
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("d0"), (3 * F.count("*")).cast("int").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    k, n, cents = F.col("k"), F.col("n"), F.col("cents")
    o = o.withColumns({"k": F.col("o_custkey") % 29, "name": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "places": F.sequence(F.lit(0), n - 1)})
    o = o.withColumn("sha256", F.sha2(F.concat_ws(":", "name", cents.cast("string")), 256))
    days = F.transform("places", lambda i: F.date_format(F.date_add("d0", i), "yyyy-MM-dd"))
    days = F.when(k == 2, F.array().cast("array<string>")).when(k == 5, F.filter(days, lambda d, i: i != 1)).when(k == 13, F.reverse(days)).otherwise(days)
    up = F.transform("places", lambda i: 1000.0 + (cents + i * 37) % 500)
    up = F.when(k == 6, F.slice(up, F.lit(1), n - 1)).when(k == 8, F.transform(up, lambda x, i: F.when(i == 1, float("nan")).otherwise(x))).when(k == 9, F.transform(up, lambda x, i: F.when(i == 1, 0.0).otherwise(x))).otherwise(up)
    hold = F.transform("places", lambda i: F.when((k == 7) & (i == 0), None).otherwise(1000.0 + (cents + i * 11) % 300))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    curves = o.select(
        "name", "sha256", day(F.date_add("d0", F.when(k == 3, 1).otherwise(0))).alias("start"), day(F.date_add("d0", F.when(k == 1, 0).when(k == 4, n + 1).otherwise(n))).alias("end"), days.alias("dates"), up.alias("strategy"), hold.alias("buy_hold"),
        F.when(k == 10, 101.0).otherwise(12.5).alias("max_drawdown_pct"), F.lit(30.0).alias("hold_drawdown_pct"), F.when(k == 11, -150.0).otherwise(5.0).alias("hold_return_pct"),
        F.transform("places", lambda i: F.when((k == 12) & (i == 0), -101.0).otherwise(((cents + i * 53) % 400).cast("double") / 10 - 20)).alias("trades"),
    )
    low = (cents % 100).cast("double") / 10 - 5
    pair = F.array(low, low + 6)
    mean = F.when(k == 16, F.array(low)).when(k == 17, F.array(low + 6, low)).when(k == 18, F.array(low, F.lit(float("inf")))).otherwise(pair)
    other = F.sha2("name", 256)
    stats = o.where("k <> 14").select("name", F.when(k == 15, other).otherwise(F.col("sha256")).alias("source_sha256"), mean.alias("mean_ci"), F.array(low / 2, low).alias("sharpe_ci"), F.when(k == 19, 1.5).otherwise((cents % 7).cast("double") / 7).alias("timing"))
    stats = stats.withColumn("sharpe_ci", F.array_sort("sharpe_ci"))
    physics = o.where("k <> 21").select("name", F.when(k == 20, other).otherwise(F.col("sha256")).alias("source_sha256"), F.when(k != 22, (cents % 13).cast("double")).alias("growth"))
    return curves, stats, physics


DESK = """
desk AS (SELECT 'c' || o_custkey AS name, o_custkey % 29 AS k, CAST(min(o_orderdate) AS DATE) AS d0, CAST(3 * count(*) AS INT) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey),
desk_rows AS (SELECT *, sha256(name || ':' || cents) AS sha256, list_transform(range(n), lambda i: CAST(d0 + CAST(i AS INT) AS DATE)) AS days,
  list_transform(range(n), lambda i: CASE WHEN k = 8 AND i = 1 THEN 'nan'::DOUBLE WHEN k = 9 AND i = 1 THEN 0::DOUBLE ELSE 1000::DOUBLE + (cents + i * 37) % 500 END) AS up,
  list_transform(range(n), lambda i: CASE WHEN k = 7 AND i = 0 THEN NULL ELSE 1000::DOUBLE + (cents + i * 11) % 300 END) AS hold,
  list_transform(range(n), lambda i: CASE WHEN k = 12 AND i = 0 THEN -101::DOUBLE ELSE CAST((cents + i * 53) % 400 AS DOUBLE) / 10 - 20 END) AS trades, CAST(cents % 100 AS DOUBLE) / 10 - 5 AS low FROM desk),
curves AS (SELECT name, sha256, k, n, CASE WHEN k = 3 THEN d0 + 1 ELSE d0 END AS start, CASE WHEN k = 1 THEN d0 WHEN k = 4 THEN d0 + n + 1 ELSE d0 + n END AS "end",
  CASE WHEN k = 2 THEN [] WHEN k = 5 THEN list_concat(days[1:1], days[3:]) WHEN k = 13 THEN list_reverse(days) ELSE days END AS days, CASE WHEN k = 6 THEN up[1:n - 1] ELSE up END AS up, hold, trades, CASE WHEN k = 10 THEN 101 ELSE 12.5 END AS dd, CASE WHEN k = 11 THEN -150 ELSE 5 END AS hr FROM desk_rows),
stats AS (SELECT name, CASE WHEN k = 15 THEN sha256(name) ELSE sha256 END AS source, CASE WHEN k = 16 THEN [low] WHEN k = 17 THEN [low + 6, low] WHEN k = 18 THEN [low, 'inf'::DOUBLE] ELSE [low, low + 6] END AS mean_ci, list_sort([low / 2, low]) AS sharpe_ci,
  CASE WHEN k = 19 THEN 1.5::DOUBLE ELSE CAST(cents % 7 AS DOUBLE) / 7 END AS timing FROM desk_rows WHERE k <> 14),
physics AS (SELECT name, CASE WHEN k = 20 THEN sha256(name) ELSE sha256 END AS source, CASE WHEN k <> 22 THEN CAST(cents % 13 AS DOUBLE) END AS growth FROM desk_rows WHERE k <> 21)"""
