"""Sources, sinks and the stream."""

import json
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.sources import files, shared, sinks
from tapeworks.sources import views
from tapeworks.streaming import assess


def test_sqlite_snapshot(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("create table trades (id integer, pair text, rate real)")
        db.executemany("insert into trades values (?, ?, ?)", [(1, "a", 1.5), (2, "b", None)])
    files.register(spark)
    df = spark.read.format("sqlite_snapshot").schema("id long, pair string, rate double").option("path", path).option("query", "select id, pair, rate from trades order by id").load()
    assert [tuple(r) for r in df.collect()] == [(1, "a", 1.5), (2, "b", None)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"candidate_id": "x"}\nbroken\n[1]\n\n{"candidate_id": "y"}\n')
    assert {r[0] for r in files.json_lines(spark, str(path), "candidate_id string").collect()} == {"x", "y"}
    with pytest.raises(Exception, match="malformed"):
        files.json_lines(spark, str(path), "candidate_id string", strict=True).collect()


def test_feather_manifest(spark, tmp_path):
    frame = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=3, freq="h", tz="UTC"), **dict.fromkeys(["open", "high", "low", "close", "volume"], 1.0)})
    frame.to_feather(tmp_path / "BTC_EUR-1h.feather")
    r = files.manifest(spark, str(tmp_path)).first()
    assert (r["pair"], r["timeframe"], r["rows"]) == ("BTC_EUR", "1h", 3) and len(r["sha256"]) == 64


def test_positional_rows(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0, 1.0, 1.0, 5.0],), ([0.0, 1.0, 2.0, 1.0, 1.0, 5.0],)], "row array<double>")
    assert files.candles_rows(rows).count() == 1
    bad = rows.union(spark.createDataFrame([([0.0, 1.0, 2.0, 1.0, 2.0, 5.0],)], "row array<double>"))
    with pytest.raises(ValueError, match="conflicting"):
        files.candles_rows(bad)


def test_archive_is_immutable(spark, tmp_path):
    path = str(tmp_path / "archive")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    bars = views.bars(spark, "/root/testdata/sf0.001").where("pair = 'view'")
    first = bars.orderBy("date").limit(50)
    (tmp_path / "archive").mkdir()
    assert sinks.update_archive(spark, path, first, now, True).count() == 50
    assert sinks.update_archive(spark, path, bars, now, True).count() == bars.count()
    with pytest.raises(ValueError, match="revised"):
        sinks.update_archive(spark, path, first.withColumn("volume", F.lit(77.0)), now)


def test_publish_latches(tmp_path):
    path = str(tmp_path / "r.json")
    assert sinks.publish(path, {"n": 1}, True)["stopped"] and sinks.publish(path, {"n": 2}, False)["stopped"]
    with pytest.raises(ValueError):
        sinks.write_report(path, {"x": float("nan")})
    assert json.load(open(path))["n"] == 2


def test_append_repairs_a_torn_line(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n{"torn')
    sinks.append_line(str(path), {"b": 2})
    assert path.read_text().splitlines()[-1] == '{"b": 2}'


def test_stream_assesses_each_candidate_once(spark, tmp_path):
    src, out, ck = tmp_path / "c.jsonl", str(tmp_path / "out"), str(tmp_path / "ck")
    src.write_text("".join(json.dumps({"candidate_id": c, "rate": 1.0}) + "\n" for c in "abca") + '{"candidate_id": "late"')
    files.register(spark)

    def provider(c):
        if c["candidate_id"] == "b":
            raise RuntimeError
        return "approve"

    def once():
        raw = spark.readStream.format("json_lines_tail").option("path", str(src)).load()
        own = raw.select(F.from_json("line", "candidate_id string, rate double").alias("x")).select("x.*")
        q = assess.run(own, provider, out, ck, 5.0, once=False)
        q.processAllAvailable()
        q.stop()
        return {r["candidate_id"]: r["decision"] for r in spark.read.parquet(out).collect()}

    assert once() == {"a": "approve", "b": "abstain", "c": "approve"}
    with src.open("a") as f:
        f.write(', "rate": 2.0}\n' + json.dumps({"candidate_id": "a"}) + "\n")
    assert once() == {"a": "approve", "b": "abstain", "c": "approve", "late": "approve"}
    assert spark.read.parquet(out).count() == 4


def test_deadline():
    import time

    ask = assess.Deadline(lambda c: time.sleep(0.4), 0.05)
    assert ask({}) == ("abstain", "timeout") and ask({}) == ("abstain", "busy")
    time.sleep(0.6)
    assert ask({}) == ("abstain", "timeout")
    assert assess.Deadline(lambda c: "buy", 1.0)({})[0] == "abstain" and assess.Deadline(lambda c: "approve", 1.0)({}) == ("approve", None)


def test_json_documents(spark, tmp_path):
    for name, text in (("good", '{"a": 1}'), ("cut", '{"a": 1'), ("list", "[1]"), ("large", '{"a": 1, "b": "' + "x" * 200 + '"}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert files.json_document(spark, str(tmp_path / "good.json"), "a int").first()["document"]["a"] == 1
    for name in ("cut", "list", "large"):
        with pytest.raises(Exception, match="JSON|too large|MALFORMED|malformed"):
            files.json_document(spark, str(tmp_path / f"{name}.json"), "a int", most=100).collect()


def test_archive_refuses_gaps(spark, tmp_path):
    hour = [(("p", f"2024-01-01 {h:02d}:00:00")) for h in (0, 1, 2, 4)]
    own = spark.createDataFrame(hour, "pair string, at string").selectExpr("pair", "cast(at as timestamp_ntz) as date", "1d as open", "1d as high", "1d as low", "1d as close", "1d as volume")
    now, path = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), str(tmp_path / "a")
    (tmp_path / "a").mkdir()
    assert sinks.update_archive(spark, path, own.where("hour(date) < 3"), now).count() == 3
    with pytest.raises(ValueError, match="gaps"):
        sinks.update_archive(spark, path, own.where("hour(date) = 4"), now)
    assert shared.Versions(spark, path).read().count() == 3
    revised = own.where("hour(date) = 1").selectExpr("pair", "date", "open", "2d as high", "low", "close", "volume")
    with pytest.raises(ValueError, match="revised"):
        sinks.update_archive(spark, path, revised, now)
    assert shared.Versions(spark, path).version() == 1
    more = own.where("hour(date) between 1 and 2").unionByName(own.where("hour(date) = 2").selectExpr("pair", "date + interval 1 hour as date", "open", "high", "low", "close", "volume"))
    assert sinks.update_archive(spark, path, more, now).count() == 4
    assert shared.Versions(spark, path).version() == 2 and spark.read.parquet(f"{path}/data/{shared.Versions(spark, path).entries()[-1]['folder']}").count() == 1
    assert sinks.update_archive(spark, path, more, now).count() == 4 and shared.Versions(spark, path).version() == 2
