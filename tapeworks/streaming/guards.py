"""Guards of a stream: gate and heartbeats as keyed state with timers, batches that fail without ending the query.

Both stateful operators run in event time: the clock is what the rows say, timers fire as the watermark passes them, and a restart
goes on from the checkpoint. State is one small record a key. They need the RocksDB state store (see USE_ROCKSDB).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Settings that the stateful operators need.
USE_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MODES = ("off", "shadow", "filter")
ASKED = "candidate_id string, at timestamp, kind string, allowed boolean, reason string, first boolean"
BEATS = "source string, at timestamp, healthy boolean, reason string"
_ASKED, _BEATS = (Row(*[c.split()[0] for c in ddl.split(", ")]) for ddl in (ASKED, BEATS))
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def _ms(t: dt.datetime) -> int:
    """Milliseconds of a time, which is UTC where it names no zone."""
    return round(((t if t.tzinfo else t.replace(tzinfo=dt.UTC)) - EPOCH).total_seconds() * 1000)


class Gate(StatefulProcessor):
    """Rows of one candidate: assessments, kept by the latest-record rule, and requests, which are answered.

    An approval opens the gate from its time on and for so many minutes; anything else fails closed, each reason marked when it is
    the first time. An approval's end is a timer: it says "expired" and the assessment is dropped, so no state is kept for good.
    A candidate is recorded at its first request in modes shadow and filter.
    """

    def __init__(self, minutes: float):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "decision string, available long")
        self.seen = handle.getMapState("seen", "reason string", "n long")

    def _end(self, available: int) -> int:
        return available + round(self.minutes * 60_000)

    def _reason(self, now: int) -> str:
        held = self.latest.get() if self.latest.exists() else None
        if held is None:
            return "no_assessment"
        decision, available = held
        if available is None:
            return "no_available_at"
        if available > now:
            return "future_available_at"
        if self._end(available) < now:
            return "expired"
        return "approved" if decision == "approve" else f"decision={decision}"

    def _first(self, reason: str) -> bool:
        if self.seen.containsKey((reason,)):
            return False
        self.seen.updateValue((reason,), (1,))
        return True

    def _assessed(self, decision: str | None, available: int | None) -> None:
        held = self.latest.get() if self.latest.exists() else None
        if held is not None and held[1] is not None and (available is None or available < held[1]):
            return
        if held is not None and held[1] is not None:
            self.handle.deleteTimer(self._end(held[1]) + 1)
        self.latest.update((decision, available))
        if available is not None:
            self.handle.registerTimer(self._end(available) + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # an assessment counts for requests of the same time; equal ones in the order of their lines
        out = []
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"] != "assessment", r["line"] or 0)):
            if r["kind"] == "assessment":
                self._assessed(r["decision"], None if r["available_at"] is None else _ms(r["available_at"]))
                continue
            mode = r["mode"]
            if mode in ("shadow", "filter") and self._first("recorded"):
                out.append(_ASKED(key[0], r["at"], "candidate", None, None, True))
            reason = "off" if mode == "off" else "shadow" if mode == "shadow" else self._reason(_ms(r["at"])) if mode == "filter" else "unknown mode"
            out.append(_ASKED(key[0], r["at"], "decision", reason in ("off", "shadow", "approved"), reason, self._first(reason)))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the assessment goes: requests from now on are as late as its end or later, and find none
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.latest.clear()
        return iter([_ASKED(key[0], EPOCH + dt.timedelta(milliseconds=at), "expiry", False, "expired", self._first("expiry"))])

    def close(self) -> None:
        pass


def gated(events: DataFrame, minutes: float, late: str = "1 minute") -> DataFrame:
    """The columns of ASKED for a stream of events: candidate_id, at (timestamp), kind (request or assessment), mode, decision,
    available_at (timestamp), line. Rows without an id or a time are left out, so they open nothing."""
    rows = events.where("candidate_id is not null and at is not null").withWatermark("at", late).groupBy("candidate_id")
    return rows.transformWithState(statefulProcessor=Gate(minutes), outputStructType=ASKED, outputMode="Append", timeMode="EventTime")


class Heartbeats(StatefulProcessor):
    """Reports of one source. A report is healthy if its verdict is CONTINUE and it was made neither in the future nor too long ago;
    STOP is latched until the source is reset. When no report comes in time, a timer says so, once for each silence."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "due long, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out = []
        for r in sorted(rows, key=lambda r: r["at"]):
            due, stopped = self.state.get() if self.state.exists() else (None, False)
            verdict, made, now = r["verdict"], r["generated_at"], _ms(r["at"])
            stopped = verdict == "STOP" or (stopped and verdict != "RESET")
            if stopped:
                reason = "stopped"
            elif verdict not in ("CONTINUE", "RESET"):
                reason = "no valid verdict"
            elif made is None:
                reason = "no valid time"
            elif _ms(made) > now:
                reason = "made in the future"
            elif now - _ms(made) > self.seconds * 1000:
                reason = "too old"
            else:
                reason = None
            if due is not None:
                self.handle.deleteTimer(due)
            due = now + round(self.seconds * 1000) + 1
            self.handle.registerTimer(due)
            self.state.update((due, stopped))
            out.append(_BEATS(key[0], r["at"], reason is None, reason or "continues"))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = EPOCH + dt.timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        return iter([_BEATS(key[0], at, False, "missed")])

    def close(self) -> None:
        pass


def heartbeats(reports: DataFrame, seconds: float, late: str = "1 second") -> DataFrame:
    """The columns of BEATS for a stream of reports: source, at (when it was read), generated_at, verdict."""
    rows = reports.where("source is not null and at is not null").withWatermark("at", late).groupBy("source")
    return rows.transformWithState(statefulProcessor=Heartbeats(seconds), outputStructType=BEATS, outputMode="Append", timeMode="EventTime")


def combined(beats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, healthy, reason: healthy if all of a key's sources are at their latest; reasons are those of the unhealthy ones, or all."""
    last = beats.groupBy(*keys, "source").agg(F.max_by(F.struct("healthy", "reason"), "at").alias("x")).select(*keys, "source", "x.*")
    said = F.sort_array(F.collect_list(F.struct("source", "reason")))  # a row a source
    bad = F.sort_array(F.collect_list(F.when(~F.col("healthy"), F.struct("source", "reason"))))
    both = last.groupBy(*keys).agg(F.bool_and("healthy").alias("healthy"), said.alias("said"), bad.alias("bad"))
    shown = F.transform(F.when(F.col("healthy"), F.col("said")).otherwise(F.col("bad")), lambda x: F.concat_ws(": ", x["source"], x["reason"]))
    return both.select(*keys, "healthy", F.array_join(shown, "; ").alias("reason"))


def decisions(reports: DataFrame, seconds: float) -> DataFrame:
    """reports (source, at, generated_at, verdict; a table) with healthy and reason, without state: the newest of each source counts
    for its freshness, any STOP that no RESET follows for the latch."""
    age = F.unix_micros("at") - F.unix_micros("generated_at")
    stop = F.max(F.when(F.col("verdict") == "STOP", F.col("at")))
    last = F.max_by(F.struct("at", "verdict", age.alias("age")), "at")
    x = reports.groupBy("source").agg(stop.alias("stop"), F.max(F.when(F.col("verdict") == "RESET", F.col("at"))).alias("reset"), last.alias("last"))
    reason = F.coalesce(
        F.when(F.col("stop").isNotNull() & (F.col("reset").isNull() | (F.col("reset") <= F.col("stop"))), "stopped"),
        F.when(~F.coalesce(F.col("last.verdict").isin("CONTINUE", "RESET"), F.lit(False)), "no valid verdict"),
        F.when(F.col("last.age").isNull(), "no valid time"), F.when(F.col("last.age") < 0, "made in the future"), F.when(F.col("last.age") > seconds * 1_000_000, "too old"),
    )
    return x.select("source", F.col("last.at").alias("at"), reason.isNull().alias("healthy"), F.coalesce(reason, F.lit("continues")).alias("reason"))


def isolated(write: Callable[[DataFrame, int], None], dead: str, key: str, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that never ends the query: a batch that fails is written again in parts by the hash of its key,
    and parts that still fail go to the Parquet folder `dead`, by batch, with the error. `write` must bear being called again."""

    def batch(own: DataFrame, number: int) -> None:
        try:
            write(own, number)
            return
        except Exception:  # whatever it is, the parts tell
            failed = []
        own = own.persist()
        try:
            for part in range(parts):
                some = own.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
                try:
                    if not some.isEmpty():
                        write(some, number)
                except Exception as e:
                    failed.append(some.withColumn("error", F.lit(f"{type(e).__name__}: {str(e)[:200]}")))
            if failed:
                out = failed[0]
                for f in failed[1:]:
                    out = out.unionByName(f)
                out.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            own.unpersist()

    return batch


__all__ = ["ASKED", "BEATS", "Gate", "Heartbeats", "USE_ROCKSDB", "combined", "decisions", "gated", "heartbeats", "isolated"]
