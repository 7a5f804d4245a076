"""Files of candles, trades and ledgers; times and frames as text; stakes, exposures and records against plain versions."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions.columns import timeframe, utc
from tapeworks.operators import candles as cd
from tapeworks.operators import matching, normal, records, trades
from tapeworks.plans import registry
from tapeworks.sources import files, shared, sinks
from tapeworks.streaming import assess

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def hours(k):
    return T0 + dt.timedelta(hours=float(k))


@pytest.fixture(scope="module")
def candle_files(tmp_path_factory):
    own = pd.DataFrame({"date": pd.date_range(T0, periods=6, freq="h"), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3.0})
    path = tmp_path_factory.mktemp("candles")
    own.to_csv(path / "a.csv", index=False, date_format="%Y-%m-%d %H:%M:%S")
    own.to_csv(path / "a.csv.gz", index=False, date_format="%Y-%m-%d %H:%M:%S")
    own.assign(date=own["date"].dt.tz_localize("UTC")).to_feather(path / "a.feather")
    rows = [[int(d.timestamp() * 1000), 1.0, 2.0, 0.5, 1.5, 3.0] for d in own["date"].dt.tz_localize("UTC")]
    (path / "a.json").write_text(json.dumps([*rows, rows[0]]))
    (path / "twice.json").write_text(json.dumps([*rows, [rows[0][0], 9.0, 9.0, 9.0, 9.0, 9.0]]))
    own.drop(index=3).to_csv(path / "gap.csv", index=False, date_format="%Y-%m-%d %H:%M:%S")
    own.assign(high=0.1).to_csv(path / "bad.csv", index=False, date_format="%Y-%m-%d %H:%M:%S")
    return path


def test_candles_of_every_kind(spark, candle_files):
    want = [("p", hours(k), 1.0, 2.0, 0.5, 1.5, 3.0) for k in range(6)]
    for name in ("a.csv", "a.csv.gz", "a.feather", "a.json"):
        assert sorted(map(tuple, files.load_candles(spark, str(candle_files / name), "p").collect())) == want, name
    inside = files.load_candles(spark, str(candle_files / "a.csv"), "p", "2024-01-01 01:00:00", "2024-01-01 03:00:00")
    assert sorted(r["date"] for r in inside.collect()) == [hours(1), hours(2), hours(3)]


@pytest.mark.parametrize(("name", "args", "why"), [("a.csv", ("2025-01-01 00:00:00",), "no candles"), ("gap.csv", (), "gaps=1"), ("bad.csv", (), "high_too_low"), ("twice.json", (), "conflicting"), ("a.xlsx", (), "unknown kind")])
def test_candles_are_refused(spark, candle_files, name, args, why):
    with pytest.raises(ValueError, match=why):
        files.load_candles(spark, str(candle_files / name), "p", *args)
    if name == "gap.csv":
        assert files.load_candles(spark, str(candle_files / name), "p", gaps_allowed=True).count() == 5


def test_trades_of_exports(spark, tmp_path):
    one = {"trade_id": 1, "pair": "a", "is_open": False, "open_date": "2024-01-01T00:00:00+01:00", "close_date": "2024-01-01 05:00:00", "open_rate": 1.0, "close_rate": 2.0, "amount": 3.0, "stake_amount": 3.0, "profit_abs": 3.0, "exit_reason": "roi"}
    two = {"trade_id": 2, "pair": "a", "is_open": True, "open_date": "2024-01-02 00:00:00", "close_date": "2024-01-03 00:00:00", "open_rate": 1.0, "fee_open": 0.1}
    (tmp_path / "bare.json").write_text(json.dumps([one]))
    (tmp_path / "held.json").write_text(json.dumps({"trades": [two], "more": 1}))
    got = {r["trade_id"]: r for r in files.trades_export(spark, str(tmp_path)).collect()}
    assert got[1]["open_date"] == dt.datetime(2023, 12, 31, 23) and got[1]["close_date"] == hours(5) and got[1]["fee_open"] == 0 and got[1]["fee_close"] is None
    assert got[2]["close_date"] is None and got[2]["fee_open"] == 0.1 and got[2]["open_date"] == hours(24)
    rows = spark.createDataFrame([("7", "x", "bad")], "TRADE_ID string, pair string, open_date string")
    assert files.typed_trades(rows).first()["trade_id"] == 7 and files.typed_trades(rows).first()["open_date"] is None


def test_ledger_refuses_a_repeated_id(spark, tmp_path):
    trial = {"id": "t", "date": "2024-01-01", "kind": "rule", "description": "d", "period": "p", "sharpe_annualised": 1.0, "counted": True}
    (tmp_path / "good.json").write_text(json.dumps([trial, trial | {"id": "u"}]))
    (tmp_path / "twice.json").write_text(json.dumps([trial, trial]))
    (tmp_path / "kind.json").write_text(json.dumps([trial | {"kind": "luck"}]))
    assert files.ledger(spark, str(tmp_path / "good.json")).count() == 2
    for name, why in (("twice", "2 times"), ("kind", "bad trial")):
        with pytest.raises(ValueError, match=why):
            files.ledger(spark, str(tmp_path / f"{name}.json"))


def test_times_and_frames_as_text(spark):
    texts = ["2024-01-01T10:00:00Z", "2024-01-01 10:00:00+02:00", "2024-01-01 10:00:00", "2024-01-01", "nonsense", "", None, "2024-02-30T00:00:00Z"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", utc(F.col("t")).alias("a"), utc(F.col("t"), strict=True).alias("b"))
    got = [(r["a"], r["b"]) for r in df.orderBy("k").collect()]
    assert got == [(hours(10), hours(10)), (hours(8), hours(8)), (hours(10), None), (hours(0), None), (None, None), (None, None), (None, None), (None, None)]
    assert [timeframe(t) for t in ("15m", "4h", "1d")] == [900_000_000, 14_400_000_000, 86_400_000_000]
    for bad in ("", "h", "0h", "4x", "-1h", "1.5h"):
        with pytest.raises(ValueError, match="timeframe"):
            timeframe(bad)


def test_stakes_look_strictly_back(spark):
    rng = np.random.default_rng(2)
    rows = [(p, hours(k), None if k % 7 == 3 else float(rng.uniform(0.25, 1))) for p in "ab" for k in range(0, 40, 2)]
    entries = [(p, 100 * i + k, hours(k), 100.0, None if k % 3 else 60.0, 90.0) for i, p in enumerate("abc") for k in range(45)]
    sized = spark.createDataFrame(rows, "pair string, date timestamp_ntz, fraction double")
    got = {r["trade_id"]: r for r in records.sized_entries(spark.createDataFrame(entries, "pair string, trade_id int, at timestamp_ntz, proposed double, least double, most double"), sized).collect()}
    assert len(got) == len(entries)
    for p, i, at, proposed, least, most in entries:
        before = [f for q, d, f in rows if q == p and d < at]
        f = before[-1] if before and before[-1] is not None else 0.25
        stake = min(most, max(proposed * f, least) if least is not None else proposed * f)
        assert (got[i]["fraction"], got[i]["stake"]) == pytest.approx((f, stake))


def test_books_show_every_issue(spark):
    issues = {r["issue"] for r in registry.queries()["reconcile"](spark, SF).select("issue").distinct().collect()}
    assert issues == {"missing_db_order", "amount_mismatch", "fee_mismatch", "stale_open_order", "missing_exchange_order"}
    db = spark.createDataFrame([(1, 5.0, 0.1, False, hours(0), 1), (1, 6.0, 0.1, False, hours(0), 2), (2, 1.0, 0.0, False, hours(0), 3), (3, 1.0, 0.0, True, hours(9), 4)], "order_id int, filled double, fee_base double, is_open boolean, order_date timestamp_ntz, line int")
    exchange = spark.createDataFrame([(1, 5.0, "closed", 0.2, "EUR", 1), (1, 6.0, "closed", 0.1, "BTC", 2)], "order_id int, filled double, status string, fee_cost double, fee_currency string, line int")
    got = sorted(map(tuple, matching.reconcile(db, exchange, F.lit("BTC"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()))
    assert got == [(1, "amount_mismatch"), (2, "missing_exchange_order")]  # each row of a repeated id once
    assert matching.reconcile(db, exchange, F.lit("BTC")).count() == 1
    later, earlier = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2023-12-01 00:00:00"))
    assert matching.lookback_since(db, later).first()[0] == hours(9) and matching.lookback_since(db, earlier).first()[0] == dt.datetime(2023, 12, 1)


def test_dust(spark):
    balances = spark.createDataFrame([("BTC", 1.0), ("ETH", 2.5), ("XMR", 0.3), ("LTC", None)], "currency string, balance double")
    held = spark.createDataFrame([("BTC", 0.4), ("BTC", 0.6), ("ETH", 2.0)], "currency string, amount double")
    assert {r["currency"]: round(r["dust"], 9) for r in matching.dust(balances, held, 1e-7).collect()} == {"ETH": 0.5, "XMR": 0.3}


def test_losing_streak_over_days_and_exposure_of_durations(spark):
    rng = np.random.default_rng(3)
    rows = [(run, k, hours(3 * k), hours(3 * k + 2), float(x)) for run in (1, 2) for k, x in enumerate(rng.choice([-1.0, 0.0, 2.0], 80, p=[0.5, 0.2, 0.3]))] + [(3, 0, hours(0), hours(1), 5.0)]
    df = spark.createDataFrame(rows, "run int, trade_id int, open timestamp_ntz, close timestamp_ntz, return_pct double")
    want = {}
    for run in (1, 2, 3):
        best = now = 0
        for r in [r for r in rows if r[0] == run]:
            now = now + 1 if r[4] <= 0 else 0
            best = max(best, now)
        want[run] = best
    assert {r["run"]: r["longest_losing_streak"] for r in trades.losing_streak(df).collect()} == want
    days = spark.createDataFrame([(1, 10), (3, 0), (4, 5)], "run int, days int")
    assert {r["run"]: r["exposure_pct"] for r in trades.duration_exposure(df, days).collect()} == pytest.approx({1: 100 * 160 / 240, 3: 0.0, 4: 0.0})


def test_freshness(spark):
    df = spark.createDataFrame([("a", hours(3)), ("b", hours(1)), ("b", hours(0))], "pair string, date timestamp_ntz")
    now = F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")
    assert {r["pair"]: r["fresh"] for r in cd.require_fresh(df, now).collect()} == {"a": True, "b": False}


def test_no_variance_no_probability(spark):
    x = spark.createDataFrame([(3.0, 5.0, 0.0), (0.1, 0.0, 0.0)], "sharpe double, skewness double, excess double")
    p = normal.deflated_sharpe(F.col("sharpe"), F.lit(0.0), F.lit(100), F.col("skewness"), F.col("excess"))
    got = [r[0] for r in x.orderBy("skewness").select(p).collect()]
    assert got[1] is None and 0.8 < got[0] < 0.9


def test_hourly_bars_of_a_stream(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    rows = [("a", hours(0), 1.0), ("a", hours(0.5), 2.0), ("b", hours(1), 4.0), ("a", hours(9), 0.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    bars = assess.bars_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = bars.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["event_type"], r["n"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2, 3.0), ("b", 1, 4.0)}  # the last hour is still open


def test_a_report_keeps_its_window(tmp_path):
    path = str(tmp_path / "r.json")
    sinks.publish(path, {"n": 1}, False, {"pair": "a", "notional": 1000})
    assert sinks.publish(path, {"n": 2}, True, {"pair": "a", "notional": 1000})["stopped"]
    with pytest.raises(ValueError, match="another window: notional"):
        sinks.publish(path, {"n": 3}, False, {"pair": "a", "notional": 500})
    assert json.load(open(path))["n"] == 2 and json.load(open(path))["stopped"]


def test_summaries_carry_what_they_rest_on(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for k in range(3):
        (data / f"{k}.txt").write_text(f"row {k}")
    made = sinks.provenance(spark, {"data": str(data)}, fee=0.005)
    assert made["fee"] == 0.005 and made["inputs"]["data"]["files"] == 3 and made["inputs"]["data"]["bytes"] == 15
    assert sinks.provenance(spark, {"data": str(data)}, fee=0.005) == made
    (data / "1.txt").write_text("row X")
    other = sinks.provenance(spark, {"data": str(data)}, fee=0.005)
    assert other["inputs"]["data"]["sha256"] != made["inputs"]["data"]["sha256"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no files"):
        sinks.provenance(spark, {"none": str(tmp_path / "none")})
    rows = spark.createDataFrame([("a", 1.0)], "run string, net double")
    where = str(tmp_path / "summary")
    assert sinks.write_summary(spark, where, rows, ["run"], made) == 1
    assert shared.Versions(spark, where).entries()[0]["provenance"]["fee"] == 0.005
    with pytest.raises(shared.Drift):
        sinks.write_summary(spark, where, rows.withColumn("net", F.lit(2.0)), ["run"], other)


def test_a_pair_whose_candles_begin_late_is_refused(spark):
    rows = {r["pair"]: r for r in registry.queries()["performance_report"](spark, SF).collect()}
    assert rows["signup"]["refused"] and rows["signup"]["net_return_pct"] is None and rows["signup"]["count"] is None
    assert all(r["refused"] is None and r["final_equity"] is not None for p, r in rows.items() if p != "signup")
