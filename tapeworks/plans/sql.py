"""DuckDB forms of the registered queries."""

from __future__ import annotations

from tapeworks.operators.normal import BOTTOM, ERFC, TOP
from tapeworks.operators.structure import scales
from tapeworks.sources.views import ASSESSMENTS, BARS, BOOKS, CANDIDATES, DAILY, ENTRIES, FEED_B, TRADES

LOGR = "lr AS (SELECT pair, date, ln(close) - ln(lag(close) OVER (PARTITION BY pair ORDER BY date)) AS r FROM bars), logr AS (SELECT * FROM lr WHERE r IS NOT NULL)"
DAYR = "dr AS (SELECT *, strategy / lag(strategy) OVER (PARTITION BY run ORDER BY date) - 1 AS r, buy_hold / lag(buy_hold) OVER (PARTITION BY run ORDER BY date) - 1 AS b FROM daily), dayr AS (SELECT * FROM dr WHERE r IS NOT NULL)"
SIGNALS = """
ch AS (
  SELECT *, CASE WHEN count(*) OVER e = 24 THEN max(high) OVER e END AS entry_high, CASE WHEN count(*) OVER x = 12 THEN min(low) OVER x END AS exit_low FROM bars
  WINDOW e AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), x AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)
), sig AS (SELECT *, coalesce(close > entry_high, false) AS enter, coalesce(close < exit_low, false) AS exit FROM ch)"""
VOL = """
vr AS (SELECT pair, date, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY date)) AS r FROM bars),
vol AS (SELECT pair, date, CASE WHEN count(r) OVER w = 24 THEN stddev_samp(r) OVER w * sqrt(8760.0::DOUBLE) END AS sigma FROM vr WINDOW w AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY available_at DESC NULLS LAST, CASE WHEN available_at IS NULL THEN line ELSE -line END) AS k FROM assessments) WHERE k = 1
)"""
#: One row of a pair's candles after the other: at most one entry and one exit a row. Times are hours.
SIM = """
st AS (
  SELECT pair, row_number() OVER w - 1 AS i, CAST(epoch(date) AS BIGINT) // 3600 AS h, open, low, close, lag(enter, 1, false) OVER w AS go, lag(exit, 1, false) OVER w AS leave, count(*) OVER (PARTITION BY pair) AS n
  FROM sig WINDOW w AS (PARTITION BY pair ORDER BY date)
), sim AS (
  SELECT pair, i, false AS pos, 0::BIGINT AS eh, 0::DOUBLE AS er, -1000000::BIGINT AS unlock, []::BIGINT[] AS stops, NULL::BIGINT AS ch, NULL::DOUBLE AS cr, NULL::VARCHAR AS why, 0::BIGINT AS oh, 0::DOUBLE AS orate FROM st WHERE i = 0
  UNION ALL
  SELECT pair, i, held AND why IS NULL, eh, er, CASE WHEN why IS NULL THEN unlock ELSE greatest(ch + 2, CASE WHEN why = 'stop_loss' AND len(kept) >= 2 THEN ch + 13 ELSE 0 END) END, kept, ch, cr, why, eh, er
  FROM (
    SELECT *, CASE WHEN why = 'stop_loss' THEN list_filter(list_append(stops, ch), lambda t: t > ch - 48) ELSE stops END AS kept
    FROM (
      SELECT *, CASE WHEN why = 'force_exit' THEN h + 1 WHEN why IS NOT NULL THEN h END AS ch,
        CASE why WHEN 'exit_signal' THEN open WHEN 'stop_loss' THEN CASE WHEN open < er * (1 + -0.01::DOUBLE) THEN open ELSE er * (1 + -0.01::DOUBLE) END WHEN 'force_exit' THEN close END AS cr
      FROM (
        SELECT *, CASE WHEN NOT held THEN NULL WHEN pos AND leave THEN 'exit_signal' WHEN low <= er * (1 + -0.01::DOUBLE) THEN 'stop_loss' WHEN i = n - 1 THEN 'force_exit' END AS why
        FROM (
          SELECT s.pair, s.i, s.h, s.open, s.low, s.close, s.leave, s.n, r.pos, r.stops, r.unlock, (r.pos OR (s.go AND s.h >= r.unlock)) AS held,
            CASE WHEN r.pos THEN r.eh ELSE s.h END AS eh, CASE WHEN r.pos THEN r.er ELSE s.open END AS er
          FROM sim r JOIN st s ON s.pair = r.pair AND s.i = r.i + 1
        )
      )
    )
  )
), trades0 AS (
  SELECT pair, make_timestamp(oh * 3600000000) AS open_date, make_timestamp(ch * 3600000000) AS close_date, orate AS open_rate, cr AS close_rate, 1000.0::DOUBLE / orate AS amount,
    cr * (1 - 0.001::DOUBLE) / (orate * (1 + 0.001::DOUBLE)) - 1 AS profit_ratio, 1000.0::DOUBLE / orate * (cr * (1 - 0.001::DOUBLE) - orate * (1 + 0.001::DOUBLE)) AS profit_abs, why AS exit_reason FROM sim WHERE why IS NOT NULL
)"""
EQUITY = """
equity AS (
  SELECT b.pair, b.date, 1000 + coalesce((SELECT sum(profit_abs) FROM trades0 t WHERE t.pair = b.pair AND t.close_date <= b.date), 0)
    + coalesce((SELECT sum(amount * (b.close * (1 - 0.001::DOUBLE) - open_rate * (1 + 0.001::DOUBLE))) FROM trades0 t WHERE t.pair = b.pair AND t.open_date <= b.date AND b.date < t.close_date), 0) AS equity FROM bars b
)"""
SUMMARY = """
dd AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM equity),
summary AS (
  SELECT d.pair, 100 * (arg_max(equity, date) / 1000 - 1) AS net_return_pct, max(100 * (peak - equity) / peak) AS mtm_max_drawdown_pct,
    coalesce((SELECT count(*) FROM trades0 t WHERE t.pair = d.pair), 0) AS trades, coalesce((SELECT count(*) FROM trades0 t WHERE t.pair = d.pair AND exit_reason = 'stop_loss'), 0) AS stop_exits FROM dd d GROUP BY d.pair
)"""
HOLD = """
hold AS (
  SELECT pair, count(*) AS candles, arg_max(close, date) / arg_min(close, date) AS gross, (CAST(epoch(max(date)) AS BIGINT) - CAST(epoch(min(date)) AS BIGINT)) / (86400 * 365.25::DOUBLE) AS years, max(dd) AS max_drawdown_pct
  FROM (SELECT *, 100 * (max(close) OVER w - close) / max(close) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)) GROUP BY pair
)"""


def ctes(*parts: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join(parts) + " "


ALL: dict[str, str] = {
    "candles_bars": ctes(BARS) + "SELECT * FROM bars",
    "candle_contract": ctes(BARS, "g AS (SELECT *, epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY pair ORDER BY date) AS gap FROM bars)")
    + "SELECT pair, count(*) AS candles, count(*) FILTER (gap <> 3600000000) AS gaps, count(*) FILTER (gap <= 0) AS not_increasing, count(*) FILTER (epoch_us(date) % 3600000000 <> 0) AS off_grid, count(*) FILTER (least(open, high, low, close) <= 0) AS bad_price,"
    " count(*) FILTER (volume < 0) AS bad_volume, count(*) FILTER (high < greatest(open, close, low)) AS high_too_low, count(*) FILTER (low > least(open, close, high)) AS low_too_high FROM g GROUP BY pair",
    "closed_filter": ctes(BARS) + "SELECT pair, count(*) AS closed, max(date) AS last FROM bars WHERE date + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY pair",
    "log_returns_open": ctes(BARS) + "SELECT pair, date, round(ln(close / coalesce(lag(close) OVER (PARTITION BY pair ORDER BY date), open)), 6) AS r FROM bars",
    "log_returns_close": ctes(BARS, LOGR) + "SELECT pair, date, round(r, 6) AS r FROM logr",
    "simple_returns": ctes(DAILY, DAYR) + "SELECT run, date, round(r, 6) AS r FROM dayr",
    "wick_ratios": ctes(BARS) + "SELECT pair, date, round(high / greatest(open, close) - 1, 6) AS upper, round(1 - low / least(open, close), 6) AS lower FROM bars",
    "channels": ctes(BARS, SIGNALS) + "SELECT pair, date, entry_high, exit_low FROM sig",
    "signals": ctes(BARS, SIGNALS) + "SELECT pair, date, enter, exit FROM sig",
    "realized_vol": ctes(BARS, VOL) + "SELECT pair, date, round(sigma, 6) AS sigma FROM vol",
    "vol_target_fraction": ctes(BARS, VOL) + "SELECT pair, date, round(CASE WHEN sigma IS NULL OR sigma <= 0 THEN 0.25 ELSE least(1, greatest(0.25::DOUBLE, 0.4::DOUBLE / sigma)) END, 6) AS fraction FROM vol",
    "drawdown_series": ctes(BARS) + "SELECT pair, date, max(close) OVER w AS peak, round(100 * (max(close) OVER w - close) / max(close) OVER w, 6) AS drawdown_pct FROM bars WINDOW w AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "daily_marks": ctes(BARS) + "SELECT pair, CAST(date AS DATE) AS day, arg_max(close, date) AS close FROM bars GROUP BY ALL",
    "underwater": ctes(DAILY, "d AS (SELECT *, greatest(150000, max(strategy) OVER w) AS peak, CAST(min(date) OVER (PARTITION BY run) AS DATE) AS day0 FROM daily WINDOW w AS (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING))",
        "e AS (SELECT *, coalesce(max(CASE WHEN strategy >= peak THEN date + 1 END) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING), day0) AS since FROM d)",
        "f AS (SELECT *, 100 * (peak - strategy) / peak AS dd, CASE WHEN strategy < peak THEN date_diff('day', CAST(since AS DATE), CAST(date + 1 AS DATE)) ELSE 0 END AS days FROM e)")
    + "SELECT run, round(100 * (arg_max(strategy, date) / 150000 - 1), 4) AS return_pct, round(max(dd), 4) AS max_drawdown_pct, round(arg_max(dd, date), 4) AS current_drawdown_pct, max(days) AS longest_underwater_days, arg_max(days, date) AS current_underwater_days FROM f GROUP BY run",
    "longest_drawdown_marks": ctes(DAILY, "d AS (SELECT *, strategy < max(strategy) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING) AS under FROM daily)",
        "e AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM d)", "f AS (SELECT run, k, count(*) FILTER (under) AS n FROM e GROUP BY ALL)")
    + "SELECT run, max(n) AS longest_drawdown_marks FROM f GROUP BY run",
    "losing_streak": ctes(TRADES, "e AS (SELECT *, sum(CASE WHEN return_pct <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY open, trade_id ROWS UNBOUNDED PRECEDING) AS k FROM trades)",
        "f AS (SELECT run, k, count(*) FILTER (return_pct <= 0) AS n FROM e GROUP BY ALL)") + "SELECT run, max(n) AS longest_losing_streak FROM f GROUP BY run",
    "yearly_returns": ctes(DAILY, "y AS (SELECT run, year(date) AS year, arg_min(strategy, date) AS s0, arg_max(strategy, date) AS s1, arg_min(buy_hold, date) AS b0, arg_max(buy_hold, date) AS b1, count(*) AS marks FROM daily GROUP BY ALL)")
    + "SELECT run, year, round(100 * (s1 / coalesce(lag(s1) OVER w, s0) - 1), 4) AS strategy_pct, round(100 * (b1 / coalesce(lag(b1) OVER w, b0) - 1), 4) AS buy_hold_pct, marks FROM y WINDOW w AS (PARTITION BY run ORDER BY year)",
    "monthly_returns": ctes(DAILY, "m AS (SELECT run, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(strategy, date) AS s, arg_max(buy_hold, date) AS b, max(date) AS through, min(date) AS first, count(*) AS marks FROM daily GROUP BY ALL)",
        "n AS (SELECT *, coalesce(lag(through + 1) OVER w, first) AS from_boundary, 100 * (s / lag(s, 1, 150000) OVER w - 1) AS sp, 100 * (b / lag(b, 1, 150000) OVER w - 1) AS bp FROM m WINDOW w AS (PARTITION BY run ORDER BY month))")
    + "SELECT run, month, CAST(from_boundary AS DATE) AS from_boundary, through, (from_boundary <> month OR day(through + 1) <> 1) AS partial_month, marks <> date_diff('day', CAST(from_boundary AS DATE), CAST(through + 1 AS DATE)) AS incomplete,"
    " marks, round(sp, 4) AS strategy_pct, round(bp, 4) AS buy_hold_pct, round(sp - bp, 4) AS excess_pp FROM n",
    "moments": ctes(BARS, LOGR, "c AS (SELECT pair, r, r - avg(r) OVER (PARTITION BY pair) AS d, avg(r) OVER (PARTITION BY pair) AS m FROM logr)", "s AS (SELECT pair, count(*) AS n, max(m) AS mean, sqrt(avg(d * d)) AS sd, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY pair)")
    + "SELECT pair, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(m3 / (sd * sd * sd), 6) AS skewness, round(m4 / (sd * sd * sd * sd) - 3, 6) AS excess_kurtosis, round(sd * sqrt(8760) * 100, 6) AS volatility_pct FROM s",
    "sharpe_sortino": ctes(DAILY, DAYR) + "SELECT run, round(stddev_samp(r) * sqrt(365) * 100, 6) AS volatility_pct, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 6) AS sharpe, round(avg(r) / nullif(sqrt(avg(pow(least(r, 0), 2))), 0) * sqrt(365), 6) AS sortino FROM dayr GROUP BY run",
    "beta_corr": ctes(DAILY, DAYR) + "SELECT run, round(covar_samp(r, b) / nullif(var_samp(b), 0), 6) AS beta, round(corr(r, b), 6) AS correlation FROM dayr GROUP BY run",
    "trade_stats": ctes(TRADES, "t AS (SELECT *, (epoch_us(close) - epoch_us(open)) / 3600000000.0::DOUBLE AS hours, row_number() OVER (PARTITION BY run ORDER BY return_pct DESC, trade_id) AS rank, return_pct AS r FROM trades)",
        "k AS (SELECT run, sum(CASE WHEN return_pct <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY open, trade_id ROWS UNBOUNDED PRECEDING) AS k, return_pct FROM trades)",
        "l AS (SELECT run, max(n) AS longest_losing_streak FROM (SELECT run, k, count(*) FILTER (return_pct <= 0) AS n FROM k GROUP BY ALL) GROUP BY run)")
    + "SELECT run, count(*) AS count, count(*) FILTER (r > 0) AS winners, round(100 * count(*) FILTER (r > 0) / count(*), 4) AS win_rate_pct, round(avg(r), 4) AS mean_pct, round(stddev_samp(r), 4) AS sd_pct, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 4) AS t_stat, round(sum(r), 4) AS sum_pct,"
    " round(CASE WHEN sum(r) FILTER (r <= 0) < 0 THEN sum(r) FILTER (r > 0) / -(sum(r) FILTER (r <= 0)) END, 4) AS profit_factor, round(avg(r) FILTER (r > 0), 4) AS mean_win_pct, round(avg(r) FILTER (r <= 0), 4) AS mean_loss_pct,"
    " round(CASE WHEN avg(r) FILTER (r <= 0) < 0 THEN avg(r) FILTER (r > 0) / -(avg(r) FILTER (r <= 0)) END, 4) AS payoff_ratio, round(sum(r) FILTER (rank <= 2), 4) AS top2_pp, round(coalesce(sum(r) FILTER (rank > 2), 0), 4) AS rest_pp,"
    " round(quantile_cont(hours, 0.5) / 24, 4) AS median_holding_days, round(avg(hours) / 24, 4) AS mean_holding_days, count(*) FILTER (exit = 'exit_signal') AS exit_exit_signal, count(*) FILTER (exit = 'force_exit') AS exit_force_exit, count(*) FILTER (exit = 'stop_loss') AS exit_stop_loss,"
    " max(longest_losing_streak) AS longest_losing_streak FROM t JOIN l USING (run) GROUP BY run",
    "exit_histogram": ctes(TRADES) + "SELECT run, exit, count(*) AS n FROM trades GROUP BY ALL",
    "exposure": ctes(TRADES, "b AS (SELECT epoch_us(TIMESTAMP '2024-01-05') AS s, epoch_us(TIMESTAMP '2024-01-25') AS e)")
    + "SELECT run, round(100 * CAST(sum(greatest(0, least(epoch_us(close), e) - greatest(epoch_us(open), s))) AS BIGINT) / max(e - s), 6) AS exposure_pct FROM trades, b GROUP BY run",
    "buy_hold": ctes(BARS, HOLD) + "SELECT pair, candles, round(100 * (gross - 1), 4) AS gross_pct, round(100 * (gross * 0.999::DOUBLE * 0.999::DOUBLE - 1), 4) AS net_pct, round(CASE WHEN years > 0 THEN 100 * (pow(gross * 0.999::DOUBLE * 0.999::DOUBLE, 1 / years) - 1) END, 4) AS cagr_pct, round(max_drawdown_pct, 4) AS max_drawdown_pct FROM hold",
    "forward_benchmark": ctes(BARS, "w AS (SELECT pair, date, 1000 / (1 + 0.001::DOUBLE) / first(open) OVER o * close * (1 - 0.001::DOUBLE) AS worth FROM bars WINDOW o AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING))",
        "d AS (SELECT *, greatest(1000, max(worth) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM w)")
    + "SELECT pair, round(arg_max(worth, date), 6) AS final, round(100 * (arg_max(worth, date) / 1000 - 1), 6) AS net_pct, round(max(100 * (peak - worth) / peak), 6) AS max_drawdown_pct FROM d GROUP BY pair",
    "hill_tail": ctes(DAILY, DAYR, "z AS (SELECT run, greatest(20, CAST(floor(count(*) * 0.05) AS BIGINT)) AS k FROM dayr GROUP BY run)",
        "x AS (SELECT run, CASE WHEN r < 0 THEN 'left' ELSE 'right' END AS side, abs(r) AS x, row_number() OVER (PARTITION BY run, r < 0 ORDER BY abs(r) DESC) AS rank FROM dayr WHERE r <> 0)",
        "h AS (SELECT run, side, k, 1 / nullif(sum(ln(x)) FILTER (rank <= k) / k - ln(max(x) FILTER (rank = k + 1)), 0) AS alpha FROM x JOIN z USING (run) WHERE rank <= k + 1 GROUP BY run, side, k)")
    + "SELECT z.run, z.k, round(max(alpha) FILTER (side = 'left'), 4) AS \"left\", round(max(alpha) FILTER (side = 'right'), 4) AS \"right\" FROM z LEFT JOIN h ON h.run = z.run GROUP BY z.run, z.k",
    "acf": ctes(BARS, LOGR, "c AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY pair) AS d FROM logr)", "l AS (SELECT CAST(unnest([1, 2, 5, 10, 24]) AS BIGINT) AS lag)", "v AS (SELECT pair, sum(d * d) AS v FROM c GROUP BY pair)")
    + "SELECT a.pair, lag, round(sum(a.d * b.d) / max(v), 6) AS acf FROM c a JOIN l ON true JOIN c b ON a.pair = b.pair AND b.i = a.i + lag JOIN v ON v.pair = a.pair GROUP BY ALL",
    "mrw_fit": ctes(DAILY, DAYR, "y AS (SELECT run, date, ln(CASE WHEN r <> 0 THEN abs(r) ELSE min(abs(r)) FILTER (r <> 0) OVER (PARTITION BY run) END) AS y FROM dayr)",
        "c AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY date) AS i, y - avg(y) OVER (PARTITION BY run) AS d, count(*) OVER (PARTITION BY run) AS n FROM y)", "l AS (SELECT unnest(range(1, 41)) AS lag)",
        "v AS (SELECT a.run, a.n, lag, sum(a.d * b.d) / count(*) AS cov FROM c a JOIN l ON true JOIN c b ON a.run = b.run AND b.i = a.i + lag GROUP BY ALL)", "f AS (SELECT run, n, regr_slope(cov, -ln(lag)) AS s, regr_intercept(cov, -ln(lag)) AS t FROM v GROUP BY ALL)")
    + "SELECT run, round(s, 4) AS lambda2, round(CASE WHEN s > 0 THEN least(greatest(exp(least(t / s, 700)), 40), 10.0::DOUBLE * n) END, 4) AS integral_scale FROM f",
    "perm_entropy": ctes(BARS, LOGR, "q AS (SELECT pair, r AS v0, lead(r, 1) OVER w AS v1, lead(r, 2) OVER w AS v2, lead(r, 3) OVER w AS v3 FROM logr WINDOW w AS (PARTITION BY pair ORDER BY date))",
        "c AS (SELECT pair, list_sort([{'v': v0, 'k': 0}, {'v': v1, 'k': 1}, {'v': v2, 'k': 2}, {'v': v3, 'k': 3}]) AS s FROM q WHERE v3 IS NOT NULL)", "n AS (SELECT pair, list_transform(s, lambda x: x.k) AS code, count(*) AS c FROM c GROUP BY ALL)", "p AS (SELECT pair, c / sum(c) OVER (PARTITION BY pair) AS p FROM n)")
    + "SELECT pair, round(-sum(p * ln(p)) / ln(24), 6) AS entropy FROM p GROUP BY pair",
    "trade_growth": ctes(TRADES, "t AS (SELECT run, return_pct / 100 AS r, CAST(round(return_pct * 10000) AS BIGINT) AS units FROM trades)", "m AS (SELECT run, sum(units) / 1000000.0::DOUBLE / count(*) AS mean, avg(ln(1 + r)) AS mean_log, var_pop(r) / 2 AS drag FROM t GROUP BY run)")
    + "SELECT run, round(mean, 9) AS mean, round(mean_log, 9) AS mean_log, round(ln(1 + mean), 9) AS log_mean, round(ln(1 + mean) - mean_log, 9) AS gap, round(drag, 9) AS volatility_drag FROM m",
    "kelly_grid": ctes(TRADES, "g AS (SELECT run, k, k * (2.0::DOUBLE / 40) AS f, return_pct / 100 AS r FROM trades, range(41) t(k))", "m AS (SELECT run, k, f, round(avg(CASE WHEN 1 + f * r <= 0 THEN -1e12 ELSE ln(1 + f * r) END), 9) AS growth FROM g GROUP BY ALL)")
    + "SELECT run, round(f, 6) AS kelly_fraction, round(growth, 6) AS growth FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY growth DESC, k) AS b FROM m) WHERE b = 1",
    "frontier": ctes(DAILY, "s AS (SELECT run, date, f, coalesce((strategy - lag(strategy) OVER (PARTITION BY run, f ORDER BY date)) / 1500000, 0) AS step FROM daily, (SELECT CAST(unnest([0.25, 0.5, 1.0]) AS DOUBLE) AS f))",
        "w AS (SELECT *, exp(sum(ln(1 + f * step)) OVER (PARTITION BY run, f ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM s)", "p AS (SELECT *, greatest(1, max(wealth) OVER (PARTITION BY run, f ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM w)")
    + "SELECT run, f, round(arg_max(wealth, date), 4) AS terminal, round(max(100 * (peak - wealth) / peak), 4) AS max_drawdown_pct, round(ln(arg_max(wealth, date)) / count(*) * 365, 4) AS growth_a_year FROM p GROUP BY ALL",
    "constant_exposure": ctes(DAILY, "s AS (SELECT run, date, coalesce(buy_hold / lag(buy_hold) OVER w - 1, 0) AS r, lead(date) OVER w IS NULL AS last FROM daily WINDOW w AS (PARTITION BY run ORDER BY date))")
    + "SELECT run, date, round(1000 * (1 - 0.00005::DOUBLE) * exp(sum(ln(1 + 0.05::DOUBLE * r)) OVER (PARTITION BY run ORDER BY date ROWS UNBOUNDED PRECEDING)) * CASE WHEN last THEN 1 - 0.00005::DOUBLE ELSE 1 END, 1) AS worth FROM s",
    "power": ctes(TRADES, "s AS (SELECT run, count(*) AS n, avg(return_pct) AS m, stddev_samp(return_pct) AS sd FROM trades GROUP BY run)", "q AS (SELECT *, CASE WHEN m > 0 AND sd > 0 THEN CAST(ceil(pow(2 * sd / m, 2)) AS BIGINT) END AS need FROM s)")
    + "SELECT run, need AS trades_needed, n / 2.0::DOUBLE AS trades_per_year, round(need / (n / 2.0::DOUBLE), 4) AS years_needed FROM q",
    "sleeves": ctes(DAILY, "v AS (SELECT run, date, f, 150000 + f * (strategy - 150000) AS w FROM daily, (SELECT CAST(unnest([0.25, 0.5, 1.0]) AS DOUBLE) AS f))", "d AS (SELECT *, greatest(150000, max(w) OVER o) AS peak, min(date) OVER (PARTITION BY run, f) AS day0 FROM v WINDOW o AS (PARTITION BY run, f ORDER BY date ROWS UNBOUNDED PRECEDING))",
        "e AS (SELECT *, coalesce(max(CASE WHEN w >= peak THEN date + 1 END) OVER (PARTITION BY run, f ORDER BY date ROWS UNBOUNDED PRECEDING), day0) AS since FROM d)",
        "g AS (SELECT run, f, 100 * (arg_max(w, date) / 150000 - 1) AS ret, max(100 * (peak - w) / peak) AS dd, max(CASE WHEN w < peak THEN date_diff('day', CAST(since AS DATE), CAST(date + 1 AS DATE)) ELSE 0 END) AS days, date_diff('day', min(date), max(date)) / 365.0::DOUBLE AS years FROM e GROUP BY run, f)")
    + "SELECT run, f AS sleeve, round(ret, 3) AS return_pct, round(dd, 3) AS max_drawdown_pct, days AS longest_underwater_days, round(ret / years, 3) AS cash_pct_a_year, round(CASE WHEN ret / 100 / years > 0 THEN 60 / (ret / 100 / years) END, 3) AS break_even_capital FROM g",
    "order_feasibility": "WITH o AS (SELECT o_orderkey AS order_id, CAST(o_orderkey % 97 AS DOUBLE) AS stake, round(o_totalprice, 2) AS price FROM orders), a AS (SELECT *, floor(stake / price / 1e-4::DOUBLE + 1e-9) * 1e-4::DOUBLE AS amount FROM o), b AS (SELECT *, amount * price AS cost, floor(amount * (1 - 0.004::DOUBLE) / 1e-4::DOUBLE + 1e-9) * 1e-4::DOUBLE AS sellable FROM a),"
    " c AS (SELECT *, stake - cost AS dust, sellable * price * (1 + -0.2::DOUBLE) AS stop_value FROM b), d AS (SELECT *, concat_ws('; ', CASE WHEN amount <= 0 THEN 'entry rounds to zero' WHEN amount < 2e-4 THEN 'entry below minimum amount' END, CASE WHEN cost < 10 THEN 'entry below minimum cost' END, CASE WHEN sellable < 2e-4 THEN 'exit below minimum amount' END, CASE WHEN stop_value < 10 THEN 'stop below minimum cost' END) AS reasons FROM c)"
    " SELECT order_id, stake, price, round(amount, 6) AS amount, round(cost, 6) AS cost, round(sellable, 6) AS sellable, round(dust, 6) AS dust, round(stop_value, 6) AS stop_value, reasons, reasons = '' AS feasible FROM d",
    "garch_filter_fixed": ctes(BARS, LOGR, "t AS (SELECT pair, date, r * r AS e2, row_number() OVER (PARTITION BY pair ORDER BY date) AS i, avg(r * r) OVER (PARTITION BY pair) AS v0 FROM logr)",
        "g AS (SELECT pair, i, date, e2, v0 AS v FROM t WHERE i = 1 UNION ALL SELECT t.pair, t.i, t.date, t.e2, 1e-6::DOUBLE + 0.1::DOUBLE * g.e2 + 0.85::DOUBLE * g.v FROM g JOIN t ON t.pair = g.pair AND t.i = g.i + 1)", recursive=True)
    + "SELECT pair, date, round(1e6::DOUBLE * v, 4) AS variance_e6 FROM g",
    "dfa_hurst": ctes(BARS, LOGR, "m AS (SELECT pair, date, r - avg(r) OVER (PARTITION BY pair) AS d, row_number() OVER (PARTITION BY pair ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM logr)",
        "p AS (SELECT pair, i, n, sum(d) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING) AS y FROM m)", "q AS (SELECT pair, n, y, 0 AS side, i FROM p UNION ALL SELECT pair, n, y, 1, n - 1 - i FROM p)",
        f"b AS (SELECT pair, side, size, i // size AS box, y, CAST(i % size AS DOUBLE) AS t FROM q, (SELECT unnest({scales(400)}) AS size) WHERE i < n // size * size)",
        "s AS (SELECT pair, size, regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t) AS rss, count(*) AS m FROM b GROUP BY pair, side, size, box)", "f AS (SELECT pair, size, sqrt(sum(rss) / sum(m)) AS f FROM s GROUP BY pair, size)")
    + "SELECT pair, round(regr_slope(ln(f), ln(size)), 6) AS hurst FROM f GROUP BY pair",
    "concentration": ctes(TRADES, "t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY return_pct DESC, trade_id) AS rank FROM trades)")
    + "SELECT run, count(*) AS trades, count(*) FILTER (rank <= 2 AND return_pct > 0) AS top_winners, round(sum(return_pct), 4) AS sum_pp, round(coalesce(sum(return_pct) FILTER (rank <= 2 AND return_pct > 0), 0), 4) AS top_two_pp, round(sum(return_pct) - coalesce(sum(return_pct) FILTER (rank <= 2 AND return_pct > 0), 0), 4) AS without_top_two_pp FROM t GROUP BY run",
    "feed_compare": ctes(BARS, FEED_B, "j AS (SELECT a.pair, date, a.close AS x, b.close AS y FROM bars a JOIN feed_b b USING (pair, date))", "k AS (SELECT *, x / lag(x) OVER w - 1 AS rx, y / lag(y) OVER w - 1 AS ry, abs(x / y - 1) * 10000 AS bps FROM j WINDOW w AS (PARTITION BY pair ORDER BY date))",
        "c AS (SELECT pair, count(*) AS candles, corr(rx, ry) AS correlation, quantile_cont(bps, 0.5) AS median_bps, quantile_cont(bps, 0.95) AS p95_bps FROM k GROUP BY pair)")
    + "SELECT pair, candles, round(correlation, 6) AS correlation, round(median_bps, 6) AS median_bps, round(p95_bps, 6) AS p95_bps, coalesce(correlation >= 0.95 AND median_bps <= 50, false) AS passes FROM c",
    "latest_per_key": ctes(BARS, CANDIDATES, ASSESSMENTS, LATEST) + "SELECT candidate_id, decision, available_at, line FROM latest",
    "unseen_anti": ctes(BARS, CANDIDATES, ASSESSMENTS) + "SELECT candidate_id, pair, signal_time FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM assessments WHERE decision = 'approve')",
    "reference_open": ctes(BARS, FEED_B, ENTRIES) + "SELECT e.pair, e.trade_id, e.open_date, round(f.open, 6) AS reference_open FROM entries e LEFT JOIN feed_b f ON f.pair = e.pair AND f.date = date_trunc('hour', e.open_date)",
    "execution_report": ctes(BARS, ENTRIES, "x AS (SELECT e.pair, (e.open * (1 + (trade_id % 7) / 10000.0::DOUBLE) / b.open - 1) * 10000 AS slip FROM entries e JOIN bars b ON b.pair = e.pair AND b.date = date_trunc('hour', e.open_date))")
    + "SELECT pair, count(*) AS trades, round(avg(slip), 4) AS mean_slippage_bps, 25.0::DOUBLE AS mean_delay_minutes, round(max(abs(slip) + 20), 4) AS max_round_trip_bps FROM x GROUP BY pair",
    "vol_lookup": ctes(BARS, VOL, ENTRIES) + "SELECT e.pair, e.trade_id, e.open_date, round(sigma, 6) AS sigma, round(CASE WHEN sigma IS NULL OR sigma <= 0 THEN 0.25 ELSE least(1, greatest(0.25::DOUBLE, 0.4::DOUBLE / sigma)) END, 6) AS fraction FROM entries e LEFT JOIN vol v ON v.pair = e.pair AND v.date = date_trunc('hour', e.open_date) - INTERVAL 1 HOUR",
    "signal_entry_match": ctes(BARS, SIGNALS, ENTRIES) + "SELECT e.pair, e.trade_id, s.date AS signal_time FROM entries e LEFT JOIN sig s ON s.pair = e.pair AND s.enter AND s.date + INTERVAL 1 HOUR <= e.open_date AND e.open_date < s.date + INTERVAL 2 HOUR",
    "order_rollup": "SELECT l_orderkey AS order_id, count(*) AS lines, count(*) FILTER (l_returnflag <> 'R') AS filled_lines, CAST(coalesce(sum(CAST(round(l_quantity) AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS filled_quantity, count(*) FILTER (l_returnflag <> 'R') = 1 AS single_fill FROM lineitem GROUP BY l_orderkey",
    "order_counts": "SELECT o_orderpriority || ':' || o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL",
    "reconcile": ctes(BOOKS, "ours AS (SELECT order_id, arg_max(filled, line) AS filled, arg_max(fee_base, line) AS fee_base FROM db GROUP BY order_id)", "theirs AS (SELECT order_id, arg_max(status, line) AS status FROM exchange GROUP BY order_id)",
        "e AS (SELECT x.*, o.order_id AS oid, o.filled AS of, o.fee_base AS ob FROM exchange x LEFT JOIN ours o USING (order_id) WHERE status = 'closed')", "d AS (SELECT b.*, t.status FROM db b LEFT JOIN theirs t USING (order_id))")
    + "SELECT order_id, 'missing_db_order' AS issue FROM e WHERE oid IS NULL UNION ALL SELECT order_id, 'amount_mismatch' FROM e WHERE abs(of - filled) > 1e-8 + 1e-6 * greatest(of, filled)"
    " UNION ALL SELECT order_id, 'fee_mismatch' FROM e WHERE fee_currency = 'BTC' AND abs(ob - fee_cost) > 1e-8 + 1e-6 * greatest(ob, fee_cost) UNION ALL SELECT order_id, 'stale_open_order' FROM d WHERE is_open AND status IN ('closed', 'canceled')"
    " UNION ALL SELECT order_id, 'missing_exchange_order' FROM d WHERE NOT is_open AND filled > 0 AND order_date >= '1995-01-01' AND status IS NULL",
    "archive_merge": ctes(BARS, FEED_B) + "SELECT * FROM feed_b UNION ALL SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM feed_b f WHERE f.pair = b.pair AND f.date = b.date)",
    "archive_revisions": ctes(BARS, FEED_B) + "SELECT pair, count(*) AS revised FROM bars b JOIN feed_b f USING (pair, date) WHERE abs(f.close - b.close) > 1e-12 + 1e-10 * greatest(abs(f.close), abs(b.close)) GROUP BY pair",
    "bootstrap_lcg": ctes(TRADES, "t AS (SELECT run, return_pct AS x, row_number() OVER (PARTITION BY run ORDER BY open, trade_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM trades)",
        "d AS (SELECT run, rep, ((rep * n + i) * 1103515245 + 12345) % 2147483648 % n AS i FROM t, range(200) r(rep))", "m AS (SELECT run, rep, round(avg(x), 9) AS mean FROM d JOIN t USING (run, i) GROUP BY ALL)")
    + "SELECT run, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg(CASE WHEN mean <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_mean_le_zero FROM m GROUP BY run",
    "block_bootstrap_lcg": ctes(DAILY, DAYR, "t AS (SELECT run, r, row_number() OVER (PARTITION BY run ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM dayr)",
        "d AS (SELECT run, rep, (((rep * CAST(ceil(n / 20) AS BIGINT) + i // 20) * 1103515245 + 12345) % 2147483648 % n + i % 20) % n AS i FROM t, range(50) r(rep) WHERE n >= 40)", "m AS (SELECT run, rep, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 9) AS s FROM d JOIN t USING (run, i) GROUP BY ALL)")
    + "SELECT run, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, round(avg(CASE WHEN s <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_sharpe_le_zero FROM m GROUP BY run",
    "kelly_bootstrap_lcg": ctes(TRADES, "t AS (SELECT run, return_pct / 100 AS r, row_number() OVER (PARTITION BY run ORDER BY open, trade_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM trades)",
        "c AS (SELECT run, rep, ((rep * n + i) * 1103515245 + 12345) % 2147483648 % n AS i, count(*) AS c FROM t, range(50) r(rep) GROUP BY ALL)", "g AS (SELECT run, i, k, k * (2.0::DOUBLE / 20) AS f, CASE WHEN 1 + k * (2.0::DOUBLE / 20) * r <= 0 THEN -1e12 ELSE ln(1 + k * (2.0::DOUBLE / 20) * r) END AS g FROM t, range(21) q(k))",
        "s AS (SELECT run, rep, k, f, round(sum(c * g), 7) AS g FROM c JOIN g USING (run, i) GROUP BY ALL)", "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, rep ORDER BY g DESC, k) AS best FROM s) WHERE best = 1)")
    + "SELECT run, round(quantile_cont(f, 0.05), 6) AS p5, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.95), 6) AS p95, round(avg(CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_zero FROM b GROUP BY run",
    "block_shuffle_lcg": ctes(BARS, LOGR, "t AS (SELECT pair, r, row_number() OVER (PARTITION BY pair ORDER BY date) - 1 AS i FROM logr)", "s AS (SELECT pair, r, row_number() OVER (PARTITION BY pair ORDER BY ((i // 30) * 1103515245 + 12345) % 2147483648, i // 30, i) - 1 AS i FROM t)")
    + "SELECT pair, i, round(r, 6) AS r, round(sum(r) OVER (PARTITION BY pair ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS level FROM s",
    "simulate": ctes(BARS, SIGNALS, SIM, recursive=True) + "SELECT pair, open_date, close_date, round(open_rate, 6) AS open_rate, round(close_rate, 6) AS close_rate, round(amount, 6) AS amount, round(profit_ratio, 6) AS profit_ratio, round(profit_abs, 6) AS profit_abs, exit_reason FROM trades0",
    "in_position": ctes(BARS, SIGNALS, SIM, recursive=True) + "SELECT pair, date, EXISTS (SELECT 1 FROM trades0 t WHERE t.pair = s.pair AND t.open_date <= s.date AND t.close_date + INTERVAL 1 HOUR > s.date) AS busy FROM sig s WHERE enter",
    "mtm_equity": ctes(BARS, SIGNALS, SIM, EQUITY, recursive=True) + "SELECT pair, date, round(equity, 4) AS equity FROM equity",
    "backtest_summary": ctes(BARS, SIGNALS, SIM, EQUITY, SUMMARY, recursive=True) + "SELECT pair, round(net_return_pct, 4) AS net_return_pct, round(mtm_max_drawdown_pct, 4) AS mtm_max_drawdown_pct, trades, stop_exits FROM summary",
    "candidate_ids": ctes(BARS, CANDIDATES) + "SELECT candidate_id, sha256('walk|' || pair || '|' || strftime(signal_time, '%Y-%m-%d %H:%M:%S') || '|v1') AS sha FROM candidates",
    "redact": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer|token)\s+[A-Za-z0-9._-]+', '\1 ***', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', '***', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '***', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '***', 'g')) AS redacted_sha FROM documents",
}

for ttl, name, columns in ((180, "asof_match", "pair, trade_id, open_date, CASE WHEN reason <> 'no_assessment' THEN candidate_id END AS candidate_id, reason, reason = 'approved' AS included FROM r"), (None, "reason_counts", "pair, reason, count(*) AS n FROM r GROUP BY ALL")):
    expired = f"WHEN available_at + INTERVAL {ttl} MINUTE < open_date THEN 'expired'" if ttl else ""
    ALL[name] = ctes(BARS, CANDIDATES, ASSESSMENTS, ENTRIES, LATEST, "a AS (SELECT e.pair, e.trade_id, e.open_date, l.candidate_id, l.signal_time, l.available_at, l.decision FROM entries e ASOF LEFT JOIN latest l ON e.pair = l.pair AND e.open_date >= l.signal_time)",
        "u AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY open_date, trade_id) AS use FROM a)",
        f"r AS (SELECT *, CASE WHEN candidate_id IS NULL OR use > 1 OR open_date - signal_time > INTERVAL 3 HOUR THEN 'no_assessment' WHEN available_at IS NULL OR available_at >= open_date THEN 'late_or_missing_availability' {expired} WHEN decision <> 'approve' THEN 'rejected' ELSE 'approved' END AS reason FROM u)") + "SELECT " + columns


def _poly(x: str, c: list[float]) -> str:
    out = f"({c[-1]!r})::DOUBLE"
    for k in reversed(c[:-1]):
        out = f"({out} * {x} + ({k!r}))"
    return out


def cdf(x: str) -> str:
    """The normal distribution function of a plain column."""
    t = f"(1 / (1 + 0.5 * abs({x}) / sqrt(2::DOUBLE)))"
    tail = f"({t} * exp(-{x} * {x} / 2 + {_poly(t, ERFC)}) / 2)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


_NEWTON = "x{1} AS (SELECT run1, root, p, x - ({0} - p) * sqrt(2 * pi()) * exp(x * x / 2) AS x FROM x{2})"
ALL["deflated_sharpe"] = ctes(DAILY, "dr AS (SELECT run, date, ln(strategy / lag(strategy) OVER (PARTITION BY run ORDER BY date)) AS r FROM daily), dayr AS (SELECT * FROM dr WHERE r IS NOT NULL)", "m AS (SELECT run, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM dayr GROUP BY run)",
    "z AS (SELECT m.run, any_value(m.n) AS n, any_value(m.mean / m.sp) AS sharpe, avg(pow((r - m.mean) / m.sp, 3)) AS skew, avg(pow((r - m.mean) / m.sp, 4)) - 3 AS excess FROM dayr JOIN m USING (run) GROUP BY m.run)",
    "best AS (SELECT sqrt(var_samp(sharpe)) AS root, CAST(count(*) AS DOUBLE) AS k FROM z)", "ps AS (SELECT 1 AS run1, root, 1 - 1 / k AS p FROM best UNION ALL SELECT 2, root, 1 - 1 / (k * exp(1::DOUBLE)) FROM best)",
    "t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM ps)", f"x0 AS (SELECT run1, root, p, (t - {_poly('t', TOP)} / {_poly('t', BOTTOM)}) * CASE WHEN p < 0.5 THEN -1 ELSE 1 END AS x FROM t)", _NEWTON.format(cdf("x"), 1, 0), _NEWTON.format(cdf("x"), 2, 1),
    "bench AS (SELECT max(root) * sum(x * CASE run1 WHEN 1 THEN 1 - 0.5772156649015329::DOUBLE ELSE 0.5772156649015329::DOUBLE END) AS benchmark FROM x2)",
    "s AS (SELECT run, sharpe, benchmark, (sharpe - benchmark) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (excess + 2) / 4 * sharpe * sharpe) AS x FROM z, bench)") + f"SELECT run, round(sharpe, 5) AS sharpe, round(benchmark, 5) AS benchmark, round({cdf('x')}, 5) AS probability FROM s"
ALL["stop_probability"] = ctes(BARS, VOL, "h AS (SELECT pair, date, sigma, -ln(0.8::DOUBLE) AS b, 30 / 365.0::DOUBLE AS t FROM vol)", "y AS (SELECT *, (-b - 0.1 * t) / (sigma * sqrt(t)) AS x1, (-b + 0.1 * t) / (sigma * sqrt(t)) AS x2 FROM h)") + f"SELECT pair, date, round(CASE WHEN sigma > 0 THEN {cdf('x1')} + exp(-0.2 * b / (sigma * sigma)) * {cdf('x2')} WHEN sigma <= 0 THEN 0 END, 5) AS probability FROM y"

# a mean of a few decimals can lie on a tie, which engines that add in another order round either way
ALL["trade_stats"] = ctes(TRADES).rstrip() + ALL["trade_stats"].removeprefix(ctes(TRADES).rstrip()).replace(", 4) AS", " + 1e-9, 4) AS")
