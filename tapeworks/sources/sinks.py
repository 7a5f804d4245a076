"""Writers: reports, append-only archives, latched state."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.candles import HOUR, archive_merge, assert_candles, check_immutable, settled

from .shared import Versions, republish


def write_report(path: str, report: dict) -> None:
    """A JSON document, complete or not there at all; NaN and infinity are refused."""
    text = json.dumps(report, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n"
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def append_line(path: str, record: dict) -> None:
    """One JSON line, flushed to disk; a last line cut short by a crash is ended first."""
    with open(path, "ab+") as f:
        if f.tell():
            f.seek(-1, os.SEEK_END)
            if f.read(1) != b"\n":
                f.write(b"\n")
        f.write(json.dumps(record, allow_nan=False).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def publish(path: str, report: dict, stop: bool, identity: dict | None = None) -> dict:
    """Write a report whose stopped flag, once set in the file, stays set. With an identity (what a window is measured by), a report
    of another window is refused and the file stays as it is."""
    was = json.load(open(path)) if os.path.exists(path) else {}
    if identity is not None and was and was.get("identity") != identity:
        changed = sorted(k for k in {*identity, *(was.get("identity") or {})} if identity.get(k) != (was.get("identity") or {}).get(k))
        raise ValueError(f"the report is of another window: {', '.join(changed)}")
    own = report | {"stopped": bool(stop or was.get("stopped"))} | ({"identity": identity} if identity is not None else {})
    write_report(path, own)
    return own


def provenance(spark: SparkSession, inputs: dict[str, str], **facts) -> dict:
    """What a result rests on: of each input (name: path of a file or folder) how many files and bytes it has and one digest over
    their names and contents, and any facts. Files are hashed by tasks, each as a whole; only digests come back."""
    known = {}
    for name, path in sorted(inputs.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        base = F.regexp_extract("path", r"([^/]+)$", 1)
        each = files.select("length", F.sha2(F.concat_ws(":", base, F.sha2("content", 256)), 256).alias("one"))
        # digests add up as numbers, so their order doesn't matter and they never meet in one list
        parts = [F.sum(F.conv(F.substring("one", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
        row = each.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.concat_ws(":", F.count("*"), *parts), 256).alias("sha256")).first()
        if not row["files"]:
            raise ValueError(f"{name}: no files in {path}")
        known[name] = row.asDict()
    return {"inputs": known} | facts


def write_summary(spark: SparkSession, path: str, summary: DataFrame, keys: list[str], made: dict, tolerance: float = 0.01) -> int:
    """Publish a summary as the next version of a table, with its provenance in the commit; drift from what is published is refused."""
    return republish(spark, path, summary, keys, tolerance, {"provenance": made})


def update_archive(spark: SparkSession, path: str, incoming: DataFrame, now: Column, gaps_allowed: bool = False) -> DataFrame:
    """Add settled candles that an archive of candles doesn't have yet, and return the archive.

    Only the new rows are written, as one commit (shared.Versions); of the archive only the stretch that the incoming candles
    touch is read. A revised candle, a gap (in the new rows or to the archived ones) or a writer that was faster (shared.Conflict)
    leaves the archive as it was.
    """
    table = Versions(spark, path)
    on = table.version()
    new = assert_candles(settled(incoming, now), gaps_allowed=True)
    old = table.read(on)
    if old is not None:
        first = new.agg(F.min("date")).first()[0]
        if first is None:
            return old
        keys = ["pair", "date"]
        touched = old.where(F.col("date") >= F.lit(first).cast("timestamp_ntz") - F.expr(f"INTERVAL {HOUR} MICROSECOND"))
        bad = check_immutable(touched, new, keys, ["open", "high", "low", "close", "volume"]).first()
        if bad is not None:
            raise ValueError(f"candle of {bad['pair']} at {bad['date']} was revised")
        last = old.groupBy("pair").agg(F.max("date").alias("date"))  # one row a pair; a pair that begins later than its end has a gap
        seam = old.join(last, keys, "left_semi").unionByName(touched).distinct()
        assert_candles(archive_merge(seam, new, keys).select(*old.columns), gaps_allowed=gaps_allowed)
        new = new.select(*old.columns).join(old.select(*keys), keys, "left_anti").select(*old.columns)
        if new.isEmpty():
            return old
    else:
        assert_candles(new, gaps_allowed=gaps_allowed)
    return table.read(table.commit(new, on))
