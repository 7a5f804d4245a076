"""Facts by period, ledgers, locks, orders and records against plain versions, and outcomes that the derived tables must show."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.operators import candles as cd
from tapeworks.operators import documents, ledger, orders, protection, records, resample, structure, stylized, variants
from tapeworks.plans import registry

SF = "/root/testdata/sf0.01"
HOUR = 3_600_000_000
T0 = dt.datetime(2024, 1, 1)


def hours(k):
    return T0 + dt.timedelta(hours=float(k))


def candles(spark, n, seed=1, pair="a"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.standard_t(4, n) * 0.01))
    return close, spark.createDataFrame([(pair, hours(k), float(c)) for k, c in enumerate(close)], "pair string, date timestamp_ntz, close double")


def plain_dfa(x):
    n = len(x)
    scales = np.unique(np.round(np.geomspace(16, n // 4, 12)).astype(int))
    profile, f = np.cumsum(x - x.mean()), []
    for s in scales:
        left = []
        for y in (profile, profile[::-1]):
            for k in range(n // s):
                box, t = y[k * s : (k + 1) * s], np.arange(s)
                left.append(((box - np.polyval(np.polyfit(t, box, 1), t)) ** 2).sum())
        f.append(math.sqrt(sum(left) / (2 * (n // s) * s)))
    return np.polyfit(np.log(scales), np.log(f), 1)[0]


def plain_entropy(x):
    codes = [tuple(np.argsort(x[k : k + 4], kind="stable")) for k in range(len(x) - 3)]
    p = np.array([codes.count(c) for c in set(codes)]) / len(codes)
    return -(p * np.log(p)).sum() / math.log(24)


def plain_facts(r):
    out = {"volatility_pct": r.std() * math.sqrt(8760) * 100, "skewness": ((r - r.mean()) ** 3).mean() / r.std() ** 3, "excess_kurtosis": ((r - r.mean()) ** 4).mean() / r.std() ** 4 - 3}
    k = max(20, int(0.05 * len(r)))
    for name, tail in (("tail_left", np.sort(-r[r < 0])[::-1]), ("tail_right", np.sort(r[r > 0])[::-1])):
        out[name] = 1 / np.log(tail[:k] / tail[k]).mean()
    for a, x in (("", r), ("abs_", abs(r))):
        d = x - x.mean()
        out |= {f"acf_{a}{lag}": (d[:-lag] * d[lag:]).sum() / (d * d).sum() for lag in (1, 2, 6, 30)}
    y = np.log(abs(r))
    d, lags = y - y.mean(), np.arange(1, 121)
    cov = [(d[:-lag] * d[lag:]).mean() for lag in lags]
    out["lambda2"] = np.polyfit(-np.log(lags), cov, 1)[0]
    return out | {"hurst": plain_dfa(r), "hurst_sizes": plain_dfa(abs(r)), "entropy": plain_entropy(r)}


def test_facts_of_overlapping_touching_and_empty_periods(spark):
    close, df = candles(spark, 900)
    periods = [("a", "2024-01-01 00:00:00", "2024-01-16 00:00:00"), ("b", "2024-01-16 00:00:00", "2024-02-01 00:00:00"), ("c", "2024-01-10 00:00:00", "2024-01-25 00:00:00"), ("none", "2024-01-05 00:00:00", "2024-01-05 00:00:00"), ("after", "2025-01-01 00:00:00", "2026-01-01 00:00:00"), ("day", "2024-01-03 00:00:00", "2024-01-04 00:00:00"), ("back", "2024-01-09 00:00:00", "2024-01-02 00:00:00")]
    got = {r["period"]: r.asDict() for r in stylized.stylized_facts(df, periods, 8760, 30).collect()}
    assert set(got) == {"a", "b", "c", "none", "after", "day", "back", "full"}
    for name, a, b in (("a", 0, 360), ("b", 360, 744), ("c", 216, 576), ("full", 0, 900)):
        assert got[name]["candles"] == b - a and got[name]["refused"] is None
        for fact, want in plain_facts(np.diff(np.log(close[a:b]))).items():
            assert got[name][fact] == pytest.approx(want, rel=1e-6, abs=1e-9), (name, fact)
        assert got[name]["hurst_low"] < 0.5 < got[name]["hurst_high"] and got[name]["entropy_low"] < got[name]["entropy_high"]
    for name, why in (("none", "no candles"), ("after", "no candles"), ("back", "no candles"), ("day", "too few tail observations")):
        assert got[name]["refused"] == why and got[name]["hurst"] is None and got[name]["volatility_pct"] is None


def test_facts_of_an_empty_table(spark):
    assert stylized.stylized_facts(candles(spark, 5)[1].where("false"), [("a", "2024-01-01 00:00:00", "2024-01-02 00:00:00")], 8760, 3).collect() == []


def test_replicates_are_whole_permutations(spark):
    rows = [("p", k, 50, float(k)) for k in range(50)]
    v = stylized.variants(spark.createDataFrame(rows, "pair string, i int, n int, r double"), ["pair"], 40).collect()
    series = {rep: [r["x"] for r in sorted((r for r in v if r["rep"] == rep), key=lambda r: r["i"])] for rep in range(-2, 40)}
    assert all(sorted(s) == list(range(50)) for s in series.values()) and series[-1] == list(range(50))
    assert len({tuple(s) for s in series.values()}) == 41  # the returns are their own sizes here
    steps = np.array([np.corrcoef(s[:-1], s[1:])[0, 1] for rep, s in series.items() if rep >= 0])
    assert abs(steps.mean()) < 0.1  # neighbours part


def test_hill_ranks_only_the_largest(spark):
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.standard_t(3, 2000) * 0.01, [0.02] * 60, [-0.03] * 60])  # ties around the limit
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(r)], "run string, date int, r double")
    got = structure.hill_tail(df, ["run"]).first()
    k = int(0.05 * len(r))
    want = [1 / np.log(t[:k] / t[k]).mean() for t in (np.sort(-r[r < 0])[::-1], np.sort(r[r > 0])[::-1])]
    assert got["k"] == k and [got["left"], got["right"]] == pytest.approx(want)


def test_garch_is_the_recursion_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(0, 0.02, 3000)
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(r)], "run string, date int, r double")
    for alpha, beta in ((0.1, 0.5), (0.3, 0.2)):  # blocks of 865 and 372 rows
        got = [x["variance"] for x in structure.garch_variance(df, ["run"], 1e-6, alpha, beta).orderBy("date").collect()]
        want = [float((r * r).mean())]
        for x in r[:-1]:
            want.append(1e-6 + alpha * x * x + beta * want[-1])
        assert got == pytest.approx(want, rel=1e-9)


def plain_lock(rows, lookback, limit, duration, step):
    """The lock after the last of rows (time in steps, ratio), in order."""
    now = rows[-1][0]
    total = peak = fall = 0.0
    n = 0
    for t, x in rows:
        if t > now - lookback:
            total, n = total + x, n + 1
            peak = max(peak, total)
            fall = max(fall, peak - total)
    end = (math.floor(now + duration) + 1) * step if fall > limit else None
    return n, fall, end


@pytest.mark.parametrize("seed", range(4))
def test_locks_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = sorted((float(t), int(k), float(x)) for k, (t, x) in enumerate(zip(np.round(rng.uniform(0, 300, 120), int(seed % 2) * 2), rng.normal(0, 0.12, 120), strict=True)))
    df = spark.createDataFrame([("r", k, hours(t), x) for t, k, x in rows], "run string, trade_id int, close timestamp_ntz, ratio double")
    got = {r["trade_id"]: r for r in protection.drawdown_locks(df, ["run"], ["trade_id"], HOUR, 20, 0.25, 7).collect()}
    locks = 0
    for i, (_, k, _) in enumerate(rows):
        n, fall, end = plain_lock([(t, x) for t, _, x in rows[: i + 1]], 20, 0.25, 7, 1)
        assert got[k]["in_window"] == n and got[k]["fall"] == pytest.approx(fall, abs=1e-12)
        if abs(fall - 0.25) > 1e-9:
            assert got[k]["lock_end"] == (None if end is None else hours(end))
            locks += end is not None
    assert 0 < locks < len(rows)


@pytest.mark.parametrize(("profits", "locks"), [([-0.25], False), ([-0.2501], True), ([10.0, -0.3], True), ([-0.15, -0.15, 0.5], True), ([0.3, -0.1, 0.4], False)])
def test_falls_are_absolute_and_strictly_above_the_limit(spark, profits, locks):
    df = spark.createDataFrame([("r", k, hours(4 * k), p) for k, p in enumerate(profits)], "run string, trade_id int, close timestamp_ntz, ratio double")
    last = protection.drawdown_locks(df, ["run"], ["trade_id"], 4 * HOUR).orderBy("trade_id").tail(1)[0]
    assert (last["lock_end"] is not None) == locks
    if locks:
        assert last["lock_end"] == hours(4 * (len(profits) - 1 + 181))


@pytest.mark.parametrize(("age", "locks"), [(540, False), (539, True)])
def test_lookback_is_strict(spark, age, locks):
    rows = [("r", 0, hours(4 * (1000 - age)), -0.2), ("r", 1, hours(4000), -0.1)]
    df = spark.createDataFrame(rows, "run string, trade_id int, close timestamp_ntz, ratio double")
    assert (protection.drawdown_locks(df, ["run"], ["trade_id"], 4 * HOUR).where("trade_id = 1").first()["lock_end"] is not None) == locks


def test_every_reason_to_refuse_a_trade(spark):
    got = {r["reason"]: r["count"] for r in registry.queries()["order_checks"](spark, SF).groupBy("reason").count().collect()}
    assert set(got) == {None, orders.UNFILLED, *orders.REASONS}


def test_small_fee_respects_the_precision(spark):
    day = dt.datetime(2024, 1, 1)
    trades = spark.createDataFrame([(1, True, 0.00007979, day, 8.0, 2), (2, True, 0.00007970, day, 8.0, 2), (3, True, 1.0, day, 8.0, 2)], "trade_id int, is_open boolean, amount double, open_date timestamp_ntz, digits double, mode int")
    fills = spark.createDataFrame([(k, "buy", "closed", False, 0.00008, 0.000000208, day, day) for k in (1, 2)], "trade_id int, side string, status string, is_open boolean, filled double, fee_base double, order_date timestamp_ntz, filled_date timestamp_ntz")
    assert {r["trade_id"]: r["reason"] for r in orders.checked_fills(trades, fills).collect()} == {1: None, 2: "entry quantity", 3: orders.UNFILLED}


def test_ledgers_show_every_reason(spark):
    common = {r["ledger"][0]: r for r in registry.queries()["ledger_common"](spark, SF).collect()}
    recorded = {r["ledger"][0]: r for r in registry.queries()["ledger_recorded"](spark, SF).collect()}
    assert ledger.NO_COMMON in common["2"]["reasons"] and ledger.FEW in common["3"]["reasons"] and ledger.MISSING in common["4"]["reasons"] and ledger.PERIODS in recorded["5"]["reasons"]
    assert common["1"]["reasons"] == common["5"]["reasons"] == "" and 0 <= common["5"]["probability"] <= 1
    for r in [*common.values(), *recorded.values()]:
        assert (r["status"] == "unavailable") == (r["variance"] is None) == (r["probability"] is None) == (r["reasons"] != "")
        assert r["sharpe_daily"] is not None


def test_ledgers_without_trials_or_returns(spark):
    trials = spark.createDataFrame([("x", 1, "trial", True, "p", 1.0), ("x", 2, "trial", True, "p", 0.5), ("y", 1, "trial", False, "p", None)], "ledger string, id int, kind string, counted boolean, period string, sharpe double")
    observed = spark.createDataFrame([("y", 0.01), ("y", 0.01)], "ledger string, r double")
    got = {r["ledger"]: r for r in ledger.ledger_report(trials, observed).collect()}
    assert got["x"]["reasons"] == "" and got["x"]["variance"] > 0 and got["x"]["days"] == 0 and got["x"]["probability"] is None
    assert got["y"]["trials_counted"] == 0 and got["y"]["sharpe_daily"] is None and ledger.FEW in got["y"]["reasons"]


def test_latest_record_follows_the_file(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k % 40), None if rng.random() < 0.4 else hours(int(rng.integers(0, 5))), k, f"d{k}") for k in range(200)]
    want = {}
    for key, at, line, d in rows:
        if key not in want or want[key][0] is None or (at is not None and at >= want[key][0]):
            want[key] = (at, line, d)
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, line int, decision string").repartition(3)
    assert {r["key"]: (r["at"], r["line"], r["decision"]) for r in records.latest_records(df, ["key"], "at", "line").collect()} == want
    assert records.latest_values(df, ["key"], ["line"], ["decision"]).count() == 40


def test_days_are_rounded_and_at_least_one(spark):
    spans = [0, 11, 12, 13, 36, 37, 60, 84, 100]
    df = spark.createDataFrame([(hours(0), hours(h)) for h in spans], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(records.whole_days(F.col("a"), F.col("b"))).collect()] == [max(1, round(h / 24)) for h in spans]


def test_assessments_choose_reject_and_expire(spark):
    q = registry.queries()
    assert {r["reason"] for r in q["reason_counts"](spark, SF).select("reason").distinct().collect()} >= {"approved", "rejected", "no_assessment", "late_or_missing_availability"}
    from tapeworks.sources import views

    a = views.assessments(spark, SF)
    assert {r["decision"] for r in a.select("decision").distinct().collect()} == {"approve", "reject", "abstain"}
    per = {r["count"] for r in a.groupBy("candidate_id").count().collect()}
    assert per == {1, 2, 3}


def test_documents_are_refused_for_every_reason(spark):
    got = {r["refused"]: r["count"] for r in registry.queries()["desk_report"](spark, SF).groupBy("refused").count().collect()}
    said = {
        "sets of runs differ", "statistics of other curves", "physics of other curves", "no growth", "period", "number of days", "days outside the period", "days not consecutive", "series not aligned",
        "value out of bounds", "drawdown out of bounds", "return out of bounds", "trade out of bounds", "mean_ci: not two bounds", "mean_ci: not finite", "mean_ci: reversed", "timing out of bounds",
    }
    assert set(got) == said | {None} and got[None] > 300


def test_broken_documents(spark):
    good = {"name": "a", "sha256": "h", "start": "2024-01-01", "end": "2024-01-04", "dates": ["2024-01-01", "2024-01-02", "2024-01-03"], "strategy": [1.0, 2.0, 1.5], "buy_hold": [1.0, 1.0, 1.0], "max_drawdown_pct": 25.0, "hold_drawdown_pct": 0.0, "hold_return_pct": 0.0, "trades": [5.0, -1.0, 2.0, 7.0]}
    broken = [
        ({}, None), ({"start": None}, "period"), ({"end": "2024-02-30"}, "period"), ({"dates": None}, "number of days"), ({"dates": ["2024-01-01", None, "2024-01-03"]}, "days not consecutive"), ({"dates": ["2024-01-01", "2024-01-01", "2024-01-03"]}, "days not consecutive"),
        ({"dates": ["x", "2024-01-02", "2024-01-03"]}, "days outside the period"), ({"strategy": [1.0, 2.0]}, "series not aligned"), ({"strategy": None}, "series not aligned"), ({"buy_hold": [1.0, None, 1.0]}, "value out of bounds"), ({"buy_hold": [1.0, float("inf"), 1.0]}, "value out of bounds"),
        ({"max_drawdown_pct": None}, "drawdown out of bounds"), ({"hold_return_pct": float("nan")}, "return out of bounds"), ({"trades": None}, "number of trades"), ({"trades": [None]}, "trade out of bounds"), ({"trades": []}, None),
        ({"dates": ["2024-01-03"], "strategy": [1.0], "buy_hold": [2.0]}, None),
    ]
    schema = "name string, sha256 string, start string, end string, dates array<string>, strategy array<double>, buy_hold array<double>, max_drawdown_pct double, hold_drawdown_pct double, hold_return_pct double, trades array<double>"
    rows = [good | {"name": f"{k:02d}"} | b for k, (b, _) in enumerate(broken)]
    curves = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert [r["refused"] for r in documents.run_errors(curves).orderBy("name").collect()] == [why for _, why in broken]
    stats = spark.createDataFrame([(r["name"], "h", [-1.0, 2.0], [0.5, 1.0], 0.5) for r in rows] + [("zz", "h", [0.0, 1.0], [0.0, 1.0], 0.0)], "name string, source_sha256 string, mean_ci array<double>, sharpe_ci array<double>, timing double")
    physics = spark.createDataFrame([], "name string, source_sha256 string, growth double")
    out = {r["name"]: r for r in documents.desk_report(documents.bound_documents(curves, stats, physics), 1.0).collect()}
    assert out["zz"]["refused"] == "sets of runs differ" and len(out) == len(rows) + 1
    a = out["00"]
    assert (a["strategy_return_pct"], a["strategy_max_drawdown_pct"], a["top_two_pp"], a["rest_pp"], a["mean_ci_includes_zero"], a["sharpe_ci_includes_zero"]) == pytest.approx((50.0, 25.0, 12.0, 1.0, True, False))
    assert out["03"]["strategy_return_pct"] is None and out["16"]["strategy_longest_underwater_days"] == 0 and out["15"]["top_two_pp"] == 0


def test_channels_of_any_length(spark):
    rng = np.random.default_rng(11)
    rows = [(p, hours(k), *map(float, sorted(rng.uniform(90, 110, 2), reverse=True)), float(rng.uniform(85, 115))) for p, n in (("a", 80), ("b", 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "pair string, date timestamp_ntz, high double, low double, close double")
    table = [(f"{a}/{b}", a, b) for a, b in ((1, 1), (2, 3), (7, 8), (16, 15), (31, 33), (79, 80), (200, 1))]
    got = {(r["pair"], r["date"], r["variant"]): r for r in variants.channel_variants(df, spark.createDataFrame(table, "variant string, entry int, exit int")).collect()}
    assert len(got) == len(rows) * len(table)
    for p in "ab":
        own = [r for r in rows if r[0] == p]
        for i, (_, at, _, _, close) in enumerate(own):
            for name, a, b in table:
                high = max(r[2] for r in own[i - a : i]) if i >= a else None
                low = min(r[3] for r in own[i - b : i]) if i >= b else None
                r = got[p, at, name]
                assert (r["entry_high"], r["exit_low"], r["enter"], r["exit"]) == (high, low, high is not None and close > high, low is not None and close < low)
    with pytest.raises(ValueError, match="variants"):
        variants.channel_variants(df, spark.createDataFrame([("x", 0, 1)], "variant string, entry int, exit int"))
    assert variants.channel_variants(df, spark.createDataFrame([], "variant string, entry int, exit int")).collect() == []


def test_audit_finds_only_a_look_ahead(spark):
    df = candles(spark, 60)[1].withColumn("x", F.col("close"))
    w = cd.ordered(["pair"])
    cuts = ["2024-01-01 10:00:00", "2024-01-02 00:30:00", "2024-01-03 12:00:00", "2023-01-01 00:00:00"]
    honest = lambda c: c.select("pair", "date", F.lag("close").over(w).alias("before"), F.avg("close").over(w.rowsBetween(-5, 0)).alias("mean"))
    assert variants.prefix_audit(honest, df, cuts, ["before", "mean"]).collect() == []
    whole = lambda c: c.select("pair", "date", (F.col("close") - F.avg("close").over(Window.partitionBy("pair"))).alias("off"), F.col("close").alias("kept"))
    found = variants.prefix_audit(whole, df, cuts, ["off", "kept"]).collect()
    assert {r["column"] for r in found} == {"off"} and {r["cut"] for r in found} == set(cuts[:2])  # the third cut is the whole
    fewer = lambda c: c.withColumn("n", F.count("*").over(Window.partitionBy("pair"))).where("n > 30").select("pair", "date", "close")
    assert {r["cut"] for r in variants.prefix_audit(fewer, df, cuts, ["close"]).collect()} == set(cuts[:2])


def test_judging_shows_every_outcome(spark):
    q = registry.queries()
    f = q["forward_criteria"](spark, SF).collect()
    assert {r["f1"] for r in f} == {"PASS", "FAIL", "NOT_YET_TESTABLE"} and {r["f2"] for r in f} == {r["f3"] for r in f} == {"PASS", "FAIL"}
    assert {r["f4"] for r in f} == {"PASS", "NOT_YET_TESTABLE"} and {r["verdict"] for r in f} == {"STOP", "CONTINUE"} and {r["may_judge"] for r in f} == {True, False}
    p = q["performance_decision"](spark, SF).collect()
    assert {r["p1"] for r in p} == {r["p2"] for r in p} == {"PASS", "FAIL", "NOT_YET_TESTABLE"} and {r["mean_supported"] for r in p} == {True, False}
    assert {r["verdict"] for r in q["paired_sizing"](spark, SF).collect()} >= {"GO", "INCONCLUSIVE"}
    assert {r["verdict"] for r in q["decision_rule"](spark, SF).collect()} == {"GO", "NO-GO"}
    k = [r["kelly_fraction"] for r in q["kelly_grid"](spark, SF).collect()]
    assert min(k) == 0 and any(0 < x < 2 for x in k)
    assert any(r["p5"] < r["p50"] < r["p95"] for r in q["kelly_bootstrap_lcg"](spark, SF).collect())
    assert all(0.01 < r["probability"] < 0.99 for r in q["deflated_sharpe"](spark, SF).collect())


def test_draws_are_never_broadcast(spark, monkeypatch):
    n, reps = 500, 40
    rows = [("ab"[k % 2], k, float((k * 7919) % 101) - 30 - k % 2) for k in range(2 * n)]
    series = spark.createDataFrame(rows, "run string, k int, x double")
    trades = series.select("run", F.col("k").alias("trade_id"), F.col("k").alias("open"), F.col("x").alias("return_pct"))
    daily = series.select("run", F.col("k").alias("date"), (F.col("x") / 100).alias("r"))
    queries = [lambda: resample.bootstrap_mean(series, ["run"], "x", ["k"], reps), lambda: resample.kelly_bootstrap(trades, reps), lambda: records.kelly_report(trades, points=5, reps=reps), lambda: resample.block_bootstrap_sharpe(daily, ["run"], 10, reps)]
    found = []
    for most, join in ((2 * n, "BroadcastHashJoin"), (2 * n - 1, "ShuffledHashJoin")):
        monkeypatch.setattr(resample, "MOST_SENT", most, raising=False)
        for q in queries:
            df = q()
            plan = df._jdf.queryExecution().executedPlan().toString()
            met = [line for line in plan.splitlines() if "HashJoin [" in line and "i#" in line]  # joins by place
            assert len(met) == 1 and join in met[0] and "BuildRight" in met[0]
            found.append(sorted(map(tuple, df.collect())))
    assert found[:4] == found[4:]
    for run, low, high, share in found[0]:
        own = np.array([x for r, _, x in rows if r == run])
        means = [own[((rep * n + np.arange(n)) * resample.A + resample.C) % resample.M % n].mean() for rep in range(reps)]
        assert (low, high, share) == pytest.approx((*np.quantile(means, [0.025, 0.975]), np.mean(np.array(means) <= 0)))
