"""The simulator's kernel on hand-made candles, and properties of signals."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import candles as cd
from tapeworks.operators import normal
from tapeworks.operators.simulate import Rules, positions
from tapeworks.sources import views

SF = "/root/testdata/sf0.001"


def run(open_, low, close, enter, leave, rules=Rules(stoploss=-0.1), fee=0.0):
    n = len(open_)
    at = np.arange(n, dtype=np.int64)
    flags = [np.isin(np.arange(n), x) for x in (enter, leave)]
    return positions(at, np.array(open_, float), np.array(low, float), np.array(close, float), *flags, rules, fee, 1)


def test_entry_and_exit_fill_at_the_next_open():
    out = run([10, 11, 12, 13, 14], [9.95] * 5, [10, 11, 12, 13, 14], [0], [2])
    assert [(t[0], t[1], t[2], t[3], t[5]) for t in out] == [(1, 3, 11, 13, "exit_signal")]


def test_stop_on_the_entry_candle_and_gap():
    assert run([10, 10, 10, 10], [10, 8, 10, 10], [10] * 4, [0], [])[0][1:6:2][0] == 1
    gap = run([10, 10, 8, 10], [10, 10, 7, 10], [10] * 4, [0], [])[0]
    assert gap[3] == 8 and gap[5] == "stop_loss"  # opened below the stop


def test_exit_signal_comes_before_the_stop():
    out = run([10, 10, 10, 10], [10, 10, 5, 10], [10] * 4, [0], [1])[0]
    assert out[5] == "exit_signal" and out[3] == 10


def test_force_exit_at_the_last_close():
    out = run([10, 10, 10], [10] * 3, [10, 10, 11], [0], [])[0]
    assert out[5] == "force_exit" and out[3] == 11 and out[1] == 3


def test_cooldown_blocks_the_next_candle():
    out = run([10] * 8, [10] * 8, [10] * 8, [0, 1, 2, 3, 4], [1])
    assert [t[0] for t in out][:2] == [1, 4]  # closed at 2: free from 4 on


def test_stop_guard_lock_end():
    rules = Rules(stoploss=-0.1, guard_limit=1, guard_duration=5)
    low = [10, 8] + [10] * 12
    out = run([10] * 14, low, [10] * 14, list(range(13)), [], rules)
    assert out[1][0] == 1 + 5 + 1


def test_signals_do_not_look_ahead(spark):
    bars = views.bars(spark, SF).where("pair = 'view'")
    cut = bars.orderBy("date").limit(150)
    whole = {r["date"]: r for r in cd.signals(bars).collect()}
    for r in cd.signals(cut).collect():
        assert whole[r["date"]]["enter"] == r["enter"] and whole[r["date"]]["exit"] == r["exit"]


def test_contract_names_the_pair(spark):
    bad = views.bars(spark, SF).withColumn("high", F.lit(1.0))
    with pytest.raises(ValueError, match="high_too_low"):
        cd.assert_candles(bad, gaps_allowed=True)


def test_contract_refuses_numbers_that_are_not_finite(spark):
    bars = views.bars(spark, SF).where("pair = 'view'")
    for column, value, rule in (("high", "inf", "bad_price"), ("open", "nan", "bad_price"), ("volume", "inf", "bad_volume"), ("volume", "nan", "bad_volume")):
        wild = bars.withColumn(column, F.lit(float(value)))
        assert cd.candle_violations(wild).first()[rule] == bars.count()


def test_normal_distribution(spark):
    exact = NormalDist()
    x = [k / 7 for k in range(-40, 41)]
    frame = spark.createDataFrame([(v, exact.cdf(v)) for v in x], "x double, p double")
    for r in frame.select("*", normal.normal_cdf(F.col("x")).alias("c"), normal.normal_quantile(F.col("p")).alias("q")).collect():
        assert abs(r["c"] - r["p"]) < 2e-7 and (abs(r["x"]) > 3 or abs(r["q"] - r["x"]) < 1e-4)
    own = spark.createDataFrame([(0.6,), (0.0,)], "s double").select(normal.stop_hit_probability(F.col("s"), 30, 0.2, 0.3).alias("p")).collect()
    b, t = -np.log(0.8), 30 / 365
    want = exact.cdf((-b - 0.3 * t) / (0.6 * t**0.5)) + np.exp(-0.6 * b / 0.36) * exact.cdf((-b + 0.3 * t) / (0.6 * t**0.5))
    assert abs(own[0]["p"] - want) < 1e-6 and own[1]["p"] == 0
