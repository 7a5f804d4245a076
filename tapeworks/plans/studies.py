"""Queries of studies: facts by period, ledgers of trials, locks, orders of trades, latest records; and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.columns import rounded
from tapeworks.operators import candles as cd
from tapeworks.operators import documents, ledger, orders, protection, records, stylized, variants
from tapeworks.operators.normal import BOTTOM, TOP
from tapeworks.sources import views
from tapeworks.sources.views import ASSESSMENTS, BARS, CANDIDATES, DESK, FILLS, TRADES, TRIALS

from . import sql

#: Overlapping, touching, empty, short and unknown stretches of time.
PERIODS = [
    ("train", "2024-01-01 00:00:00", "2024-01-15 00:00:00"),
    ("validation", "2024-01-15 00:00:00", "2024-01-25 00:00:00"),
    ("middle", "2024-01-08 00:00:00", "2024-01-22 12:00:00"),
    ("nothing", "2024-01-10 00:00:00", "2024-01-10 00:00:00"),
    ("later", "2024-02-10 00:00:00", "2024-03-10 00:00:00"),
    ("week", "2024-01-25 00:00:00", "2024-02-01 00:00:00"),
]
PER_YEAR, REPS = 24 * 365, 200
STEP, LOOKBACK, LIMIT, DURATION = 3_600_000_000, 48, 0.25, 12


@views.candles_once
def stylized_facts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stylized.stylized_facts(views.bars(spark, d), PERIODS, PER_YEAR, REPS), 4)


def ledger_common(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers whose trials are compared where they overlap."""
    trials, returns, observed = views.trials(spark, d)
    return rounded(ledger.ledger_report(ledger.on_common_part(trials, returns), observed), 5)


def ledger_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The same ledgers with the Sharpe ratio that each trial has on its own period."""
    trials, returns, observed = views.trials(spark, d)
    own = returns.join(trials.select("ledger", "id", "start", "end"), ["ledger", "id"]).where((F.col("date") >= F.col("start")) & (F.col("date") < F.col("end")))
    recorded = trials.join(ledger.sharpes(own, ["ledger", "id"]), ["ledger", "id"], "left")
    period = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    return rounded(ledger.ledger_report(recorded.select("ledger", "id", "kind", "counted", period.alias("period"), "sharpe"), observed), 5)


def drawdown_locks(spark: SparkSession, d: str) -> DataFrame:
    t = views.trades(spark, d).select("run", "trade_id", "close", (F.col("return_pct") / 100).alias("ratio"))
    return rounded(protection.drawdown_locks(t, ["run"], ["trade_id"], STEP, LOOKBACK, LIMIT, DURATION), 6)


def order_checks(spark: SparkSession, d: str) -> DataFrame:
    return orders.checked_fills(*views.fills(spark, d))


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    rows = views.assessments(spark, d)
    return records.latest_records(rows, ["candidate_id"], "available_at", "line").select("candidate_id", "decision", "available_at", "line")


def desk_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(documents.desk_report(documents.bound_documents(*views.desk_documents(spark, d)), 1000.0), 4)


#: Channels: name, rows of the entry, rows of the exit.
VARIANTS = [("short", 10, 5), ("base", 24, 12), ("long", 55, 20), ("longer", 60, 30), ("longest", 330, 120), ("one", 1, 1), ("power", 64, 32)]
CUTS = [f"2024-01-{k:02d} 07:30:00" for k in (3, 9, 16, 25)]


def channel_variants(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(VARIANTS, "variant string, entry int, exit int")
    return variants.channel_variants(views.bars(spark, d), table)


@views.candles_once
def lookahead_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of channel signals to which a look at the next candle is added: only that column comes back."""
    ahead = F.lead("close").over(cd.ordered(["pair"])) > F.col("close")
    query = lambda c: cd.signals(c).withColumn("ahead", F.coalesce(ahead, F.lit(False)))
    return variants.prefix_audit(query, views.bars(spark, d), CUTS, ["entry_high", "exit_low", "enter", "exit", "ahead"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stylized_facts, ledger_common, ledger_recorded, drawdown_locks, order_checks, latest_records, desk_report, channel_variants, lookahead_audit)}

_PERIODS = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', '{a}', '{b}')" for n, a, b in PERIODS)
_KEEP = lambda c: f"CASE WHEN refused IS NULL THEN round({c}, 4) END AS {c}"
_LAGS = [(a, c, k) for a, c in (("", "d"), ("abs_", "s")) for k in stylized.LAGS]
_STYLIZED = sql.ctes(
    BARS,
    f"periods AS (SELECT * FROM (VALUES {_PERIODS}, ('full', TIMESTAMP '1900-01-01', TIMESTAMP '2900-01-01', NULL, NULL)) t(period, a, b, start, \"end\"))",
    "held AS (SELECT pair, period, date, close FROM bars JOIN periods ON date >= a AND date < b)",
    "counted AS (SELECT pair, period, count(*) AS candles FROM held GROUP BY ALL)",
    "steps AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS r, row_number() OVER w - 2 AS i, count(*) OVER (PARTITION BY pair, period) - 1 AS n FROM held WINDOW w AS (PARTITION BY pair, period ORDER BY date))",
    "ret AS MATERIALIZED (SELECT pair, period, i, n, r, r - avg(r) OVER p AS d, abs(r) - avg(abs(r)) OVER p AS s, ln(CASE WHEN r <> 0 THEN abs(r) ELSE min(abs(r)) FILTER (r <> 0) OVER p END) AS y0 FROM steps WHERE i >= 0 WINDOW p AS (PARTITION BY pair, period))",
    "cen AS MATERIALIZED (SELECT *, y0 - avg(y0) OVER (PARTITION BY pair, period) AS y FROM ret)",
    "mom AS (SELECT pair, period, n, sqrt(avg(d * d)) AS sd, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4, sum(d * d) AS dd, sum(s * s) AS ss FROM cen GROUP BY ALL)",
    f"lagged AS (SELECT u.pair, u.period, l AS lag, sum(u.d * v.d) AS d, sum(u.s * v.s) AS s FROM cen u, (SELECT unnest({list(stylized.LAGS)}) AS l) JOIN cen v ON u.pair = v.pair AND u.period = v.period AND v.i = u.i + l GROUP BY ALL)",
    "acfs AS (SELECT pair, period, " + ", ".join(f"coalesce(max({c} / {c * 2}) FILTER (lag = {k}), 0) AS acf_{a}{k}" for a, c, k in _LAGS) + " FROM lagged JOIN mom USING (pair, period) GROUP BY ALL)",
    f"covs AS (SELECT u.pair, u.period, u.n, l AS lag, sum(u.y * v.y) / (u.n - l) AS cov FROM cen u, (SELECT unnest(range(1, {stylized.MAX_LAG + 1})) AS l) JOIN cen v ON u.pair = v.pair AND u.period = v.period AND v.i = u.i + l WHERE u.n > {stylized.MAX_LAG} GROUP BY u.pair, u.period, u.n, l)",
    f"mrw AS (SELECT pair, period, s AS lambda2, CASE WHEN s > 0 THEN least(greatest(exp(least(t / s, 700)), {stylized.MAX_LAG}), 10.0::DOUBLE * n) END AS integral_scale FROM (SELECT pair, period, n, regr_slope(cov, -ln(lag)) AS s, regr_intercept(cov, -ln(lag)) AS t FROM covs GROUP BY ALL))",
    "size AS (SELECT pair, period, greatest(20, n // 20) AS k FROM mom)",
    "ranked AS (SELECT pair, period, r < 0 AS loss, abs(r) AS x, row_number() OVER (PARTITION BY pair, period, r < 0 ORDER BY abs(r) DESC) AS rank FROM ret WHERE r <> 0)",
    "hill AS (SELECT pair, period, k, loss, 1 / nullif(sum(ln(x)) FILTER (rank <= k) / k - ln(max(x) FILTER (rank = k + 1)), 0) AS alpha FROM ranked JOIN size USING (pair, period) WHERE rank <= k + 1 GROUP BY pair, period, k, loss)",
    "tails AS (SELECT pair, period, k AS tail_k, max(alpha) FILTER (loss) AS tail_left, max(alpha) FILTER (NOT loss) AS tail_right FROM hill GROUP BY ALL)",
    f"reps AS (SELECT pair, period, n, i, r, rep, ((rep * n + i) * 1103515245 + 12345) % 2147483648 AS k0 FROM ret, range({REPS}) t(rep))",
    "reps1 AS (SELECT *, (xor(k0, k0 >> 15) * 1103515245 + 12345) % 2147483648 AS k1 FROM reps)",
    "reps2 AS (SELECT *, (xor(k1, k1 >> 13) * 1103515245 + 12345) % 2147483648 AS k2 FROM reps1)",
    "vars AS MATERIALIZED (SELECT pair, period, n, rep, row_number() OVER (PARTITION BY pair, period, rep ORDER BY k2, i) - 1 AS i, r AS x FROM reps2 UNION ALL SELECT pair, period, n, -1, i, r FROM ret UNION ALL SELECT pair, period, n, -2, i, abs(r) FROM ret)",
    "prof AS MATERIALIZED (SELECT pair, period, n, rep, i, sum(x - m) OVER (PARTITION BY pair, period, rep ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT *, avg(x) OVER (PARTITION BY pair, period, rep) AS m FROM vars) WHERE n >= 64)",
    "sizes AS (SELECT pair, period, unnest(list_distinct(list_transform(range(12), lambda q: CAST(round_even(16 * pow(n // 4 / 16::DOUBLE, q / 11::DOUBLE), 0) AS BIGINT)))) AS size FROM mom WHERE n >= 64)",
    "boxes AS (SELECT pair, period, rep, size, side, CASE side WHEN 0 THEN i ELSE n - 1 - i END AS place, n, y FROM prof JOIN sizes USING (pair, period), range(2) t(side))",
    "fits AS (SELECT pair, period, rep, size, regr_syy(y, CAST(place % size AS DOUBLE)) - pow(regr_sxy(y, CAST(place % size AS DOUBLE)), 2) / regr_sxx(y, CAST(place % size AS DOUBLE)) AS rss, count(*) AS m FROM boxes WHERE place < n // size * size GROUP BY pair, period, rep, size, side, place // size)",
    "fluct AS (SELECT pair, period, rep, size, sqrt(sum(rss) / sum(m)) AS f FROM fits GROUP BY ALL)",
    "hurst AS (SELECT pair, period, rep, regr_slope(ln(f), ln(size)) AS h FROM fluct GROUP BY ALL)",
    "hursts AS (SELECT pair, period, max(h) FILTER (rep = -1) AS hurst, max(h) FILTER (rep = -2) AS hurst_sizes, quantile_cont(h, 0.025) FILTER (rep >= 0) AS hurst_low, quantile_cont(h, 0.975) FILTER (rep >= 0) AS hurst_high FROM hurst GROUP BY ALL)",
    "quads AS (SELECT pair, period, rep, x AS v0, lead(x) OVER w AS v1, lead(x, 2) OVER w AS v2, lead(x, 3) OVER w AS v3 FROM vars WINDOW w AS (PARTITION BY pair, period, rep ORDER BY i))",
    "codes AS (SELECT pair, period, rep, (v0 > v1)::INT * 1 + (v0 > v2)::INT * 2 + (v1 > v2)::INT * 4 + (v0 > v3)::INT * 8 + (v1 > v3)::INT * 16 + (v2 > v3)::INT * 32 AS code, count(*) AS c FROM quads WHERE v3 IS NOT NULL GROUP BY ALL)",
    "ent AS (SELECT pair, period, rep, -sum(p * ln(p)) / ln(24) AS e FROM (SELECT *, c / sum(c) OVER (PARTITION BY pair, period, rep) AS p FROM codes) GROUP BY ALL)",
    "ents AS (SELECT pair, period, max(e) FILTER (rep = -1) AS entropy, quantile_cont(e, 0.025) FILTER (rep >= 0) AS entropy_low, quantile_cont(e, 0.975) FILTER (rep >= 0) AS entropy_high FROM ent GROUP BY ALL)",
    "scale AS (SELECT pair, period, min(size) AS scale_min, max(size) AS scale_max FROM sizes GROUP BY ALL)",
    f"every AS (SELECT b.pair, p.period, p.start, p.\"end\", coalesce(candles, 0) AS candles, sd * sqrt({PER_YEAR}) * 100 AS volatility_pct, CASE WHEN sd = 0 THEN 0 ELSE m3 / pow(sd, 3) END AS skewness, CASE WHEN sd = 0 THEN -3 ELSE m4 / pow(sd, 4) - 3 END AS excess_kurtosis,"
    " acfs.* EXCLUDE (pair, period), mrw.* EXCLUDE (pair, period), tails.* EXCLUDE (pair, period), hursts.* EXCLUDE (pair, period), ents.* EXCLUDE (pair, period), scale.* EXCLUDE (pair, period),"
    f" CASE WHEN coalesce(candles, 0) = 0 THEN 'no candles' WHEN tail_left IS NULL OR tail_right IS NULL THEN 'too few tail observations' WHEN candles - 1 <= {stylized.MAX_LAG} OR candles - 1 < 64 THEN 'too short' END AS refused"
    " FROM (SELECT DISTINCT pair FROM bars) b CROSS JOIN periods p LEFT JOIN counted c ON c.pair = b.pair AND c.period = p.period LEFT JOIN mom ON mom.pair = b.pair AND mom.period = p.period LEFT JOIN acfs ON acfs.pair = b.pair AND acfs.period = p.period"
    " LEFT JOIN mrw ON mrw.pair = b.pair AND mrw.period = p.period LEFT JOIN tails ON tails.pair = b.pair AND tails.period = p.period LEFT JOIN hursts ON hursts.pair = b.pair AND hursts.period = p.period LEFT JOIN ents ON ents.pair = b.pair AND ents.period = p.period LEFT JOIN scale ON scale.pair = b.pair AND scale.period = p.period)",
) + "SELECT pair, period, start, \"end\", candles, " + ", ".join(
    [_KEEP(c) for c in ("volatility_pct", "skewness", "excess_kurtosis", "tail_left", "tail_right", *[f"acf_{a}{k}" for a, _, k in _LAGS], "hurst", "hurst_sizes", "hurst_low", "hurst_high", "entropy", "entropy_low", "entropy_high", "lambda2", "integral_scale")]
    + [f"CASE WHEN refused IS NULL THEN {c} END AS {c}" for c in ("tail_k", "scale_min", "scale_max")]
) + ", refused FROM every"


def _quantile(p: str) -> str:
    """The quantile of the normal distribution: a rational start and two steps of Newton's method."""
    x = f"((t - {sql._poly('t', TOP)} / {sql._poly('t', BOTTOM)}) * CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END)"
    return x


def _ledger(source: str) -> str:
    newton = "{new} AS (SELECT * REPLACE (x - ({cdf} - p) * sqrt(2 * pi()) * exp(x * x / 2) AS x) FROM {old})"
    g = "0.5772156649015329::DOUBLE"
    return sql.ctes(
        TRIALS, source,
        "agg AS (SELECT ledger, count(*) FILTER (counted) AS trials_counted, count(*) FILTER (counted AND sharpe IS NOT NULL) AS trials_with_sharpe, count(DISTINCT period) FILTER (counted) AS periods, count(*) FILTER (counted AND period IS NULL) AS nowhere, var_samp(sharpe / sqrt(365)) FILTER (counted) AS v FROM shown GROUP BY ledger)",
        f"why AS (SELECT *, concat_ws('; ', CASE WHEN nowhere > 0 THEN '{ledger.NO_COMMON}' END, CASE WHEN trials_with_sharpe < trials_counted THEN '{ledger.MISSING}' END, CASE WHEN periods > 1 THEN '{ledger.PERIODS}' END, CASE WHEN trials_with_sharpe < 2 THEN '{ledger.FEW}' END) AS reasons FROM agg)",
        "ps AS (SELECT ledger, 1 AS which, 1 - 1 / trials_counted::DOUBLE AS p FROM why WHERE reasons = '' UNION ALL SELECT ledger, 2, 1 - 1 / (trials_counted * exp(1::DOUBLE)) FROM why WHERE reasons = '')",
        "ts AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM ps)", f"q0 AS (SELECT ledger, which, p, {_quantile('p')} AS x FROM ts)",
        newton.format(new="q1", old="q0", cdf=sql.cdf("x")), newton.format(new="q2", old="q1", cdf=sql.cdf("x")),
        f"top AS (SELECT ledger, sum(x * CASE which WHEN 1 THEN 1 - {g} ELSE {g} END) AS top FROM q2 GROUP BY ledger)",
        "o1 AS (SELECT ledger, count(*) AS days, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM observed GROUP BY ledger)",
        "o2 AS (SELECT o1.ledger, any_value(days) AS days, any_value(mean / sd) AS sharpe_daily, avg(pow((r - mean) / sp, 3)) AS skewness, avg(pow((r - mean) / sp, 4)) - 3 AS excess_kurtosis FROM observed o JOIN o1 ON o.ledger = o1.ledger GROUP BY o1.ledger)",
        "j AS (SELECT w.*, CASE WHEN reasons = '' THEN v END AS variance, CASE WHEN reasons = '' THEN sqrt(v) * top END AS best, days, sharpe_daily, skewness, excess_kurtosis FROM why w LEFT JOIN top USING (ledger) LEFT JOIN o2 USING (ledger))",
        "z AS (SELECT *, (sharpe_daily - best) * sqrt(days - 1) / sqrt(1 - skewness * sharpe_daily + (excess_kurtosis + 2) / 4 * sharpe_daily * sharpe_daily) AS x FROM j)",
    ) + f"""SELECT ledger, trials_counted, trials_with_sharpe, CASE WHEN reasons = '' THEN 'assumption_dependent' ELSE 'unavailable' END AS status, reasons, coalesce(days, 0) AS days, round(sharpe_daily, 5) AS sharpe_daily, round(sharpe_daily * sqrt(365), 5) AS sharpe_annual,
        round(skewness, 5) AS skewness, round(excess_kurtosis, 5) AS excess_kurtosis, round(variance, 5) AS variance, round(best, 5) AS expected_max_daily, round(best * sqrt(365), 5) AS expected_max_annual, CASE WHEN x IS NOT NULL THEN round({sql.cdf('x')}, 5) END AS probability FROM z"""  # fmt: skip


_SHARPE = "CASE WHEN count(r) > 1 AND min(r) < max(r) THEN avg(r) / stddev_samp(r) * sqrt(365) END"
_RECORDED = f"shown AS (SELECT t.ledger, t.id, any_value(counted) AS counted, any_value(start || '..' || \"end\") AS period, {_SHARPE} AS sharpe FROM trials t LEFT JOIN trial_returns r ON r.ledger = t.ledger AND r.id = t.id AND date >= start AND date < \"end\" GROUP BY t.ledger, t.id)"
_COMMON = (
    "common AS (SELECT ledger, max(start) AS low, min(\"end\") AS high FROM trials WHERE counted GROUP BY ledger), "
    f"shown AS (SELECT t.ledger, t.id, any_value(counted) AS counted, any_value(CASE WHEN low < high THEN low || '..' || high END) AS period, {_SHARPE} AS sharpe FROM trials t JOIN common c ON c.ledger = t.ledger LEFT JOIN trial_returns r ON r.ledger = t.ledger AND r.id = t.id AND date >= low AND date < high GROUP BY t.ledger, t.id)"
)
_REASON = " ".join(f"WHEN {c} THEN '{r}'" for c, r in zip(
    ("nonterminal > 0", "entries <> 1 OR exits <> (CASE WHEN is_open THEN 0 ELSE 1 END) OR fills <> entries + exits", "digits IS NULL OR mode IS NULL OR mode NOT IN (2, 3, 4)", "digits < 0 OR (mode = 4 AND digits = 0)", "expected <= 0",
     "abs(amount - expected) > greatest(1e-10::DOUBLE * greatest(abs(amount), abs(expected)), unit * 1.000001::DOUBLE)", "exits > 0 AND abs(sold - amount) > greatest(1e-10::DOUBLE * greatest(abs(sold), abs(amount)), unit * 1.000001::DOUBLE)"), orders.REASONS, strict=True))

SQL: dict[str, str] = {
    "stylized_facts": _STYLIZED,
    "ledger_recorded": _ledger(_RECORDED),
    "ledger_common": _ledger(_COMMON),
    "drawdown_locks": sql.ctes(
        TRADES,
        f"met AS (SELECT t.run, t.trade_id, t.close, t.return_pct / 100 AS ratio, row_number() OVER w AS k, sum(a.return_pct / 100) OVER w AS c FROM trades t JOIN trades a ON a.run = t.run AND epoch_us(a.close) > epoch_us(t.close) - {LOOKBACK * STEP} AND (a.close, a.trade_id) <= (t.close, t.trade_id) WINDOW w AS (PARTITION BY t.run, t.trade_id ORDER BY a.close, a.trade_id ROWS UNBOUNDED PRECEDING))",
        "peaks AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY run, trade_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak FROM met)",
        "falls AS (SELECT run, trade_id, any_value(close) AS close, any_value(ratio) AS ratio, count(*) AS in_window, max(peak - c) AS fall FROM peaks GROUP BY run, trade_id)",
    )
    + f"SELECT run, trade_id, close, round(ratio, 6) AS ratio, in_window, round(fall, 6) AS fall, CASE WHEN fall > {LIMIT}::DOUBLE THEN make_timestamp(((epoch_us(close) + {DURATION * STEP}) // {STEP} + 1) * {STEP}) END AS lock_end FROM falls",
    "order_checks": sql.ctes(
        FILLS,
        "own AS (SELECT trade_id, count(*) FILTER (is_open OR filled_date IS NULL OR status IS NULL OR status NOT IN ('closed', 'canceled', 'cancelled', 'expired', 'rejected')) AS nonterminal, count(*) AS fills, count(*) FILTER (side = 'buy') AS entries, count(*) FILTER (side IN ('sell', 'stoploss')) AS exits,"
        " max(filled) FILTER (side = 'buy') AS bought, max(fee_base) FILTER (side = 'buy') AS fee_base, max(filled) FILTER (side IN ('sell', 'stoploss')) AS sold, max(filled_date) FILTER (side = 'buy') AS entered, max(order_date) FILTER (side IN ('sell', 'stoploss')) AS left_at, max(filled_date) FILTER (side IN ('sell', 'stoploss')) AS exited FROM fill_orders WHERE filled > 0 GROUP BY trade_id)",
        "x AS (SELECT t.*, coalesce(nonterminal, 0) AS nonterminal, coalesce(fills, 0) AS fills, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits, bought - coalesce(fee_base, 0) AS expected, sold, entered, left_at, exited FROM fill_trades t LEFT JOIN own USING (trade_id))",
        "y AS (SELECT *, CASE WHEN mode = 4 THEN digits WHEN mode = 2 THEN pow(10::DOUBLE, -floor(digits)) WHEN mode = 3 AND expected > 0 THEN pow(10::DOUBLE, floor(log10(expected)) - floor(digits) + 1) END AS unit FROM x)",
        f"z AS (SELECT *, CASE WHEN nonterminal = 0 AND entries = 0 AND exits = 0 AND is_open THEN '{orders.UNFILLED}' {_REASON} END AS reason FROM y)",
    )
    + "SELECT trade_id, reason, CASE WHEN reason IS NULL THEN open_date END AS submitted_date, CASE WHEN reason IS NULL THEN entered END AS open_date, CASE WHEN reason IS NULL THEN left_at END AS exit_submitted_date, CASE WHEN reason IS NULL THEN exited END AS close_date FROM z",
    "latest_records": sql.ctes(BARS, CANDIDATES, ASSESSMENTS, "numbered_records AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY available_at DESC NULLS LAST, line DESC) AS k FROM assessments)") + "SELECT candidate_id, decision, available_at, line FROM numbered_records WHERE k = 1",
    "desk_report": sql.ctes(
        DESK,
        "j AS (SELECT coalesce(c.name, s.name) AS name, c.* EXCLUDE (name), s.source AS stats_source, mean_ci, sharpe_ci, timing, p.source AS physics_source, p.name AS physics_name, growth FROM curves c FULL JOIN stats s ON c.name = s.name LEFT JOIN physics p ON p.name = c.name)",
        "ok AS (SELECT *, list_filter(list_concat(up, hold), lambda x: x IS NULL OR isnan(x) OR x < 0.000001 OR x > 1e15) AS bad_values, list_filter(trades, lambda x: x < -100) AS bad_trades, list_filter(range(1, len(days)), lambda i: days[i + 1] - days[i] <> 1) AS bad_days FROM j)",
        "why AS (SELECT *, CASE WHEN sha256 IS NULL OR stats_source IS NULL THEN 'sets of runs differ' WHEN stats_source <> sha256 THEN 'statistics of other curves' WHEN physics_name IS NOT NULL AND physics_source <> sha256 THEN 'physics of other curves' WHEN physics_name IS NOT NULL AND growth IS NULL THEN 'no growth'"
        " WHEN \"end\" - start < 1 THEN 'period' WHEN len(days) < 1 THEN 'number of days' WHEN days[1] < start OR days[-1] <> \"end\" - 1 THEN 'days outside the period' WHEN len(bad_days) > 0 THEN 'days not consecutive' WHEN len(up) <> len(days) OR len(hold) <> len(days) THEN 'series not aligned'"
        " WHEN len(bad_values) > 0 THEN 'value out of bounds' WHEN dd > 100 THEN 'drawdown out of bounds' WHEN hr < -100 THEN 'return out of bounds' WHEN len(bad_trades) > 0 THEN 'trade out of bounds'"
        " WHEN len(mean_ci) <> 2 THEN 'mean_ci: not two bounds' WHEN isinf(mean_ci[2]) THEN 'mean_ci: not finite' WHEN mean_ci[1] > mean_ci[2] THEN 'mean_ci: reversed' WHEN sharpe_ci[1] > sharpe_ci[2] THEN 'sharpe_ci: reversed' WHEN timing > 1 THEN 'timing out of bounds' END AS refused FROM ok)",
        "flat AS (SELECT name, start, unnest(days) AS date, unnest(up) AS strategy, unnest(hold) AS hold FROM why WHERE refused IS NULL)",
        "sides AS (SELECT name, 's' AS side, start, date, strategy AS v FROM flat UNION ALL SELECT name, 'h', start, date, hold FROM flat)",
        "peaks AS (SELECT *, greatest(1000, max(v) OVER (PARTITION BY name, side ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM sides)",
        "since AS (SELECT *, coalesce(max(CASE WHEN v >= peak THEN date + 1 END) OVER (PARTITION BY name, side ORDER BY date ROWS UNBOUNDED PRECEDING), start) AS since FROM peaks)",
        "und AS (SELECT name, side, 100 * (arg_max(v, date) / 1000 - 1) AS ret, max(100 * (peak - v) / peak) AS dd, max(CASE WHEN v < peak THEN date_diff('day', CAST(since AS DATE), CAST(date + 1 AS DATE)) ELSE 0 END) AS days FROM since GROUP BY name, side)",
        "best AS (SELECT name, coalesce(list_sum(list_filter(list_reverse_sort(trades), lambda x: x > 0)[1:2]), 0) AS top, list_sum(trades) AS total FROM why)",
    )
    + "SELECT w.name, refused, CASE WHEN refused IS NULL THEN CAST(len(w.days) AS BIGINT) END AS days, CASE WHEN refused IS NULL THEN round(top, 4) END AS top_two_pp, CASE WHEN refused IS NULL THEN round(total - top, 4) END AS rest_pp, CASE WHEN refused IS NULL THEN mean_ci[1] <= 0 AND mean_ci[2] >= 0 END AS mean_ci_includes_zero,"
    " CASE WHEN refused IS NULL THEN sharpe_ci[1] <= 0 AND sharpe_ci[2] >= 0 END AS sharpe_ci_includes_zero, CASE WHEN refused IS NULL THEN round(timing, 4) END AS timing, CASE WHEN refused IS NULL THEN round(growth, 4) END AS growth,"
    " round(s.ret, 4) AS strategy_return_pct, round(s.dd, 4) AS strategy_max_drawdown_pct, s.days AS strategy_longest_underwater_days, round(h.ret, 4) AS hold_return_pct, round(h.dd, 4) AS hold_max_drawdown_pct, h.days AS hold_longest_underwater_days"
    " FROM why w LEFT JOIN best USING (name) LEFT JOIN und s ON s.name = w.name AND s.side = 's' LEFT JOIN und h ON h.name = w.name AND h.side = 'h'",
    "channel_variants": sql.ctes(BARS, "rows_ AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY date) AS i FROM bars)") + " UNION ALL ".join(
        f"SELECT pair, date, '{n}' AS variant, CASE WHEN count(*) OVER e = {a} THEN max(high) OVER e END AS entry_high, CASE WHEN count(*) OVER x = {b} THEN min(low) OVER x END AS exit_low, coalesce(close > (CASE WHEN count(*) OVER e = {a} THEN max(high) OVER e END), false) AS enter, coalesce(close < (CASE WHEN count(*) OVER x = {b} THEN min(low) OVER x END), false) AS exit"
        f" FROM rows_ WINDOW e AS (PARTITION BY pair ORDER BY date ROWS BETWEEN {a} PRECEDING AND 1 PRECEDING), x AS (PARTITION BY pair ORDER BY date ROWS BETWEEN {b} PRECEDING AND 1 PRECEDING)" for n, a, b in VARIANTS),
    "lookahead_audit": sql.ctes(BARS, f"cuts AS (SELECT unnest({CUTS}) AS cut)", "ends AS (SELECT pair, cut, max(date) AS date FROM bars, cuts WHERE date < CAST(cut AS TIMESTAMP) GROUP BY pair, cut)", "n AS (SELECT pair, date, lead(close) OVER (PARTITION BY pair ORDER BY date) > close AS ahead FROM bars)")
    + "SELECT pair, date, cut, 'ahead' AS \"column\" FROM ends JOIN n USING (pair, date) WHERE ahead",
}
