"""Candidates stream to assessments: each candidate id is assessed once, late or failing calls abstain."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The answers a provider may give.
DECISIONS = ["approve", "reject", "abstain"]
ASSESSMENT = "candidate_id string, decision string, error string, latency_ms long"


class Deadline:
    """Asks a provider under a time limit. While a call that has timed out still runs, no other one is begun."""

    def __init__(self, provider: Callable[[dict], str], seconds: float):
        self.provider, self.seconds, self.last = provider, seconds, None

    def __call__(self, candidate: dict) -> tuple[str, str | None]:
        """The provider's decision, or abstain with the reason if it fails, answers otherwise, takes too long or is still busy."""
        if self.last is not None and self.last.is_alive():
            return "abstain", "busy"
        answer: queue.Queue = queue.Queue(1)

        def call() -> None:
            try:
                answer.put((self.provider(candidate), None))
            except Exception as e:  # any failure of a provider is an abstention
                answer.put((None, type(e).__name__))

        self.last = threading.Thread(target=call, daemon=True)
        self.last.start()
        try:
            decision, error = answer.get(timeout=self.seconds)
        except queue.Empty:
            return "abstain", "timeout"
        self.last = None
        return (decision, None) if decision in DECISIONS else ("abstain", error or "unknown decision")


def assessed(candidates: DataFrame, provider: Callable[[dict], str], seconds: float = 30.0) -> DataFrame:
    """The columns of ASSESSMENT for candidates (candidate_id and whatever the provider reads)."""

    def rows(batches):
        import pandas as pd

        ask = Deadline(provider, seconds)
        for b in batches:
            out = []
            for x in b.to_dict("records"):
                began = time.time()
                decision, error = ask(x)
                out.append((x["candidate_id"], decision, error, int(1000 * (time.time() - began))))
            yield pd.DataFrame(out, columns=["candidate_id", "decision", "error", "latency_ms"])

    return candidates.mapInPandas(rows, ASSESSMENT)


def run(candidates: DataFrame, provider: Callable[[dict], str], out: str, checkpoint: str, seconds: float = 30.0, once: bool = True) -> StreamingQuery:
    """Assess a stream into a Parquet folder, by batch. Ids seen before are known to the query's state, so the sink is never read;
    a batch that runs again replaces what it wrote."""

    def batch(own: DataFrame, number: int) -> None:
        assessed(own, provider, seconds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    new = candidates.where("candidate_id is not null").dropDuplicates(["candidate_id"])
    writer = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()


def bars_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly count and value of each event type, as events (ts timestamp) arrive; a window closes when the watermark passes."""
    hour = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("date"), "event_type", "n", "value")
