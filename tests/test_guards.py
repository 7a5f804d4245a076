"""Stateful guards with a driven clock, error isolation, leases, and tables by a log of commits."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from tapeworks.sources import shared
from tapeworks.streaming import guards

T0 = dt.datetime(2024, 1, 1, 12)


def minute(m):
    return None if m is None else T0 + dt.timedelta(minutes=m)


@pytest.fixture(scope="module")
def rocks(spark):
    for k, v in guards.USE_ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k in guards.USE_ROCKSDB:
        spark.conf.unset(k)


class Driven:
    """A stream of files, one a call, each run to its end; what came out of it so far."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.dir, self.schema, self.make = spark, tmp_path, schema, make
        (tmp_path / "in").mkdir()
        self.n, self.seen = 0, 0

    def __call__(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.dir / "in"))
        q = self.make(self.spark.readStream.schema(self.schema).parquet(str(self.dir / "in"))).writeStream.format("parquet").option("path", str(self.dir / "out")).option("checkpointLocation", str(self.dir / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        every = self.spark.read.parquet(str(self.dir / "out")).collect()
        new, self.seen = len(every) - self.seen, len(every)
        return every, new


EVENTS = "candidate_id string, at timestamp, kind string, mode string, decision string, available_at timestamp, line long"


def test_gate_decides_expires_and_survives_a_restart(rocks, tmp_path):
    run = Driven(rocks, tmp_path, EVENTS, lambda df: guards.gated(df, 30, "0 seconds"))

    def ask(c, m, mode="filter"):
        return (c, minute(m), "request", mode, None, None, None)

    def say(c, m, decision, available, line=0):
        return (c, minute(m), "assessment", None, decision, minute(available), line)

    every, _ = run([ask("a", 0), ask("a", 1), say("a", 2, "approve", 2), ask("a", 3), say("b", 1, "reject", 1), ask("b", 2), say("c", 1, "approve", 9), ask("c", 2), say("d", 1, "approve", None), ask("d", 2), ask("e", 1, "off"), ask("f", 1, "shadow"), ask("g", 1, "fitler"), ask("h", 2, None),
                    (None, minute(1), "request", "filter", None, None, None)])
    said = {(r["candidate_id"], r["at"]): (r["allowed"], r["reason"], r["first"]) for r in every if r["kind"] == "decision"}
    assert said["a", minute(0)] == (False, "no_assessment", True) and said["a", minute(1)] == (False, "no_assessment", False) and said["a", minute(3)] == (True, "approved", True)
    assert said["b", minute(2)][:2] == (False, "decision=reject") and said["c", minute(2)][:2] == (False, "future_available_at") and said["d", minute(2)][:2] == (False, "no_available_at")
    assert said["e", minute(1)][:2] == (True, "off") and said["f", minute(1)][:2] == (True, "shadow") and said["g", minute(1)][:2] == said["h", minute(2)][:2] == (False, "unknown mode")
    recorded = [r["candidate_id"] for r in every if r["kind"] == "candidate"]
    assert sorted(recorded) == ["a", "b", "c", "d", "f"]
    # another process goes on from the checkpoint: later records win, ties too, earlier and undated ones don't
    every, new = run([say("a", 10, "reject", 1), ask("a", 11), say("b", 10, "approve", 1, 7), ask("b", 11), say("c", 10, "reject", None), ask("c", 11), say("d", 10, "approve", 10), ask("d", 12)])
    said = {(r["candidate_id"], r["at"]): (r["allowed"], r["reason"]) for r in every if r["kind"] == "decision"}
    assert said["a", minute(11)] == said["b", minute(11)] == said["c", minute(11)] == said["d", minute(12)] == (True, "approved") and new == 4
    # the end of its time is inclusive; the watermark passes it and the timer says so once
    every, _ = run([ask("a", 32), ask("z", 33)])
    assert [(r["allowed"], r["reason"]) for r in every if r["candidate_id"] == "a" and r["at"] == minute(32)] == [(True, "approved")]
    every, _ = run([ask("z", 60)])
    every, _ = run([ask("a", 61), ask("z", 62)])
    ended = [r for r in every if r["kind"] == "expiry"]
    assert {r["candidate_id"] for r in ended} == {"a", "b", "c", "d"} and all(not r["allowed"] for r in ended)
    assert [r["reason"] for r in every if r["candidate_id"] == "a" and r["at"] == minute(61)] in (["expired"], ["no_assessment"])
    assert sum(r["kind"] == "candidate" and r["candidate_id"] == "a" for r in every) == 1


def test_heartbeats_miss_latch_and_refuse_other_clocks(rocks, tmp_path):
    run = Driven(rocks, tmp_path, "source string, at timestamp, generated_at timestamp, verdict string", lambda df: guards.heartbeats(df, 300, "0 seconds"))
    every, _ = run([("a", minute(0), minute(0), "CONTINUE"), ("b", minute(0), minute(1), "CONTINUE"), ("c", minute(0), minute(-6), "CONTINUE"), ("d", minute(0), None, "CONTINUE"), ("e", minute(0), minute(0), "MAYBE"), ("f", minute(0), minute(0), "STOP"), ("g", minute(0), minute(-5), "CONTINUE")])
    said = {r["source"]: (r["healthy"], r["reason"]) for r in every}
    assert said == {"a": (True, "continues"), "b": (False, "made in the future"), "c": (False, "too old"), "d": (False, "no valid time"), "e": (False, "no valid verdict"), "f": (False, "stopped"), "g": (True, "continues")}
    every, _ = run([("f", minute(4), minute(4), "CONTINUE"), ("a", minute(4), minute(4), "CONTINUE")])
    assert {(r["source"], r["healthy"]) for r in every if r["at"] == minute(4)} == {("f", False), ("a", True)}
    every, _ = run([("f", minute(7), minute(7), "RESET")])
    every, _ = run([("f", minute(8), minute(8), "CONTINUE")])
    missed = [(r["source"], r["at"]) for r in every if r["reason"] == "missed"]
    assert sorted(s for s, _ in missed) == ["b", "c", "d", "e", "g"]  # a and f were heard of at 4
    assert [r["healthy"] for r in every if r["source"] == "f" and r["at"] in (minute(7), minute(8))] == [True, True]
    every, _ = run([("z", minute(20), minute(20), "CONTINUE")])
    every, _ = run([("z", minute(21), minute(21), "CONTINUE")])
    missed = sorted(r["source"] for r in every if r["reason"] == "missed")
    assert missed == ["a", "b", "c", "d", "e", "f", "g"]  # once for each silence


def test_decisions_of_a_table_and_their_union(spark):
    rows = [("a", minute(0), minute(0), "STOP"), ("a", minute(1), minute(1), "CONTINUE"), ("b", minute(1), minute(0), "CONTINUE"), ("c", minute(0), minute(0), "STOP"), ("c", minute(1), minute(1), "RESET"), ("d", minute(9), minute(1), "CONTINUE"), ("e", minute(1), minute(2), "CONTINUE"), ("f", minute(1), minute(1), None)]
    df = spark.createDataFrame(rows, "source string, at timestamp, generated_at timestamp, verdict string")
    got = guards.decisions(df, 300)
    assert {r["source"]: r["reason"] for r in got.collect()} == {"a": "stopped", "b": "continues", "c": "continues", "d": "too old", "e": "made in the future", "f": "no valid verdict"}
    bad = guards.combined(got.withColumn("all", F.lit(1)), ["all"]).first()
    assert not bad["healthy"] and bad["reason"] == "a: stopped; d: too old; e: made in the future; f: no valid verdict"
    good = guards.combined(got.where("healthy").withColumn("all", F.lit(1)), ["all"]).first()
    assert good["healthy"] and good["reason"] == "b: continues; c: continues"


def test_a_poison_row_sinks_neither_query_nor_batch(spark, tmp_path):
    src, out, dead = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "dead")
    src.mkdir()

    def write(df, number):
        df.select("id", F.when(F.col("x") == 0, F.raise_error(F.lit("poison"))).otherwise(100 / F.col("x")).alias("y")).write.mode("append").parquet(f"{out}/{number}")

    def go():
        q = spark.readStream.schema("id string, x int").json(str(src)).writeStream.foreachBatch(guards.isolated(write, dead, "id")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    (src / "a.json").write_text("".join(json.dumps({"id": f"r{k}", "x": k}) + "\n" for k in range(40)))
    go()
    (src / "b.json").write_text(json.dumps({"id": "later", "x": 5}) + "\n")
    go()
    lost = spark.read.parquet(dead).collect()
    assert "r0" in {r["id"] for r in lost} and len(lost) < 12 and all("poison" in r["error"] for r in lost) and {r["batch"] for r in lost} == {0}
    kept = {r["id"] for r in spark.read.parquet(f"{out}/0", f"{out}/1").collect()}
    assert kept | {r["id"] for r in lost} == {f"r{k}" for k in range(40)} | {"later"} and not kept & {r["id"] for r in lost}


def test_lease_has_one_holder_and_fences_the_others(spark, tmp_path):
    now = [100.0]
    a, b = (shared.Lease(spark, str(tmp_path / "lease"), owner, 60, lambda: now[0]) for owner in "ab")
    first = a.acquire()
    with pytest.raises(shared.Busy):
        b.acquire()
    assert a.renew() == a.check() > first
    now[0] += 61  # a hung: its time is over
    assert b.acquire() > a.number
    for late in (a.check, a.renew):
        with pytest.raises(shared.Lost):
            late()
    wrote = []
    with pytest.raises(shared.Lost):
        shared.fenced(a, lambda df, n: wrote.append(n))(None, 1)
    shared.fenced(b, lambda df, n: wrote.append(n))(None, 2)
    assert wrote == [2]
    a.release()  # not its own any more
    b.check()
    b.release()
    with a():
        assert a.check() > 0
    again = shared.Lease(spark, str(tmp_path / "lease"), "a", 60, lambda: now[0])  # a restart of the same instance
    assert again.acquire() > 0


def test_a_lease_is_given_once_however_many_ask(spark, tmp_path):
    won = []

    def ask(k):
        try:
            won.append(shared.Lease(spark, str(tmp_path / "lease"), str(k)).acquire())
        except shared.Busy:
            pass

    threads = [threading.Thread(target=ask, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1


def test_versions_conflict_and_read_back(spark, tmp_path):
    table = shared.Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version() == 0
    rows = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert table.commit(rows, 0) == 1 and table.commit(rows.selectExpr("k + 1 as k", "v"), 1) == 2
    with pytest.raises(shared.Conflict):
        table.commit(rows, 1)
    assert table.read().count() == 2 and table.read(1).count() == 1 and len(table.data.names()) == 2
    table.commit(rows.selectExpr("k + 9 as k", "v"), 2, anew=True)
    assert [r["k"] for r in table.read().collect()] == [10]


def test_rebuilding_refuses_drift_and_a_faster_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "curves")
    rows = spark.createDataFrame([("a", 1, 100.0, "x"), ("a", 2, None, "x"), (None, 1, 5.0, "y")], "run string, day int, v double, note string")
    assert shared.republish(spark, path, rows, ["run", "day"]) == 1
    close = rows.withColumn("v", F.col("v") + 0.009).unionByName(rows.limit(1).withColumn("day", F.lit(3)))
    assert shared.republish(spark, path, close, ["run", "day"], note={"by": "test"}) == 2
    for bad, why in ((rows.withColumn("v", F.col("v") + 0.03), "v was"), (close.where("day < 2"), "row was"), (close.withColumn("note", F.lit("z")), "note was"), (close.withColumn("v", F.coalesce("v", F.lit(1.0))), "v was None")):
        with pytest.raises(shared.Drift, match=why):
            shared.republish(spark, path, bad, ["run", "day"])
    table = shared.Versions(spark, path)
    assert table.version() == 2 and table.entries()[-1]["by"] == "test" and table.read().count() == 4
    monkeypatch.setattr(shared.Versions, "version", lambda self: 1)  # as a slower writer sees it
    with pytest.raises(shared.Conflict):
        shared.Versions(spark, path).commit(close, 1, anew=True)
