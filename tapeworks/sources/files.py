"""Readers: candle files, ledgers, documents, SQLite snapshots and growing JSON-lines files."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tapeworks.functions.columns import utc
from tapeworks.operators.candles import assert_candles

CANDLES = "date timestamp_ntz, open double, high double, low double, close double, volume double"
LEDGER = "id string, date string, kind string, description string, period string, sharpe_annualised double, counted boolean"
#: The kinds of a ledger's trials.
KINDS = ["baseline", "benchmark", "parameter", "robustness", "rule", "variant"]


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """path and candles of (gzipped) CSV files with a header. A gzipped file is one task; write large ones as Parquet once."""
    rows = spark.read.schema(CANDLES).option("header", "true").csv(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), *rows.columns)


def candles_json(spark: SparkSession, path: str) -> DataFrame:
    """path and candles of JSON documents that are arrays of positional rows [ms, open, high, low, close, volume]."""
    docs = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", "array<array<double>>", {"mode": "FAILFAST"})).alias("row"))
    cols = [F.timestamp_millis(F.col("row")[0].cast("long")).cast("timestamp_ntz").alias("date"), *[F.col("row")[k].alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)]]
    own = docs.select("path", *cols).dropDuplicates()
    twice = own.groupBy("path", "date").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"conflicting candles at {twice['date']} in {twice['path']}")
    return own


def load_candles(spark: SparkSession, path: str, pair: str, start: str | None = None, end: str | None = None, gaps_allowed: bool = False) -> DataFrame:
    """pair and the candles of a file or folder from `start` to `end`, both included, which keep the contract of candles: by its
    suffix Feather (.feather), CSV (.csv, .csv.gz) or JSON (.json). None in the window is an error."""
    readers = {".feather": candles_feather, ".csv": candles_csv, ".csv.gz": candles_csv, ".json": candles_json}
    suffix = next((x for x in sorted(readers, key=len, reverse=True) if path.rstrip("/").endswith(x)), None)
    if suffix is None:
        raise ValueError(f"candles of an unknown kind: {path}")
    own = readers[suffix](spark, path)
    for t, later in ((start, True), (end, False)):
        if t is not None:
            at = F.lit(t).cast("timestamp_ntz")
            own = own.where(F.col("date") >= at if later else F.col("date") <= at)
    own = own.select(F.lit(pair).alias("pair"), "date", "open", "high", "low", "close", "volume")
    if own.isEmpty():
        raise ValueError(f"no candles of {pair} in the window")
    return assert_candles(own, gaps_allowed=gaps_allowed)


#: Columns of an export of trades, with their types; times are ISO text.
EXPORT = "trade_id long, pair string, is_open boolean, open_date string, close_date string, open_rate double, close_rate double, amount double, stake_amount double, fee_open double, fee_close double, profit_abs double, profit_ratio double, exit_reason string, strategy string, timeframe string"


def typed_trades(rows: DataFrame) -> DataFrame:
    """Trades as operators/forward.py takes them, of rows with any of EXPORT's columns: types are cast, times are UTC, a missing entry
    fee is zero, what is missing of a close stays null; a trade said to be open has no close."""
    have = {c.lower(): c for c in rows.columns}
    cols = []
    for field in EXPORT.split(", "):
        name, kind = field.split()
        c = F.col(have[name]) if name in have else F.lit(None)
        cols.append((utc(c.cast("string")) if name.endswith("_date") else c.cast(kind)).alias(name))
    t = rows.select(*cols).withColumn("fee_open", F.coalesce("fee_open", F.lit(0.0)))
    ended = ~F.coalesce("is_open", F.lit(False))
    return t.select(*[F.when(ended, F.col(c)).alias(c) if c == "close_date" else F.col(c) for c in t.columns if c != "is_open"], F.lit(None).cast("timestamp_ntz").alias("submitted_date"))


def trades_export(spark: SparkSession, path: str) -> DataFrame:
    """typed_trades() of JSON exports: documents that are arrays of trades, or hold such an array as `trades`."""
    item = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in EXPORT.split(", ")) + ">>"
    text = spark.read.option("wholetext", "true").text(path)
    bare = F.startswith(F.trim("value"), F.lit("["))
    rows = F.when(bare, F.from_json("value", item, {"mode": "FAILFAST"})).otherwise(F.from_json("value", f"struct<trades:{item}>", {"mode": "FAILFAST"})["trades"])
    return typed_trades(text.select(F.inline(rows)))


def candles_feather(spark: SparkSession, path: str, pattern: str = "*.feather") -> DataFrame:
    """path, date, open, high, low, close, volume of Feather files, a task for each group of files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.feather as feather

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                own = feather.read_feather(io.BytesIO(content))
                own["date"] = pd.to_datetime(own["date"], utc=True).dt.tz_localize(None)
                yield own.assign(path=name)[["path", "date", "open", "high", "low", "close", "volume"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(read, f"path string, {CANDLES}")


def candles_rows(rows: DataFrame) -> DataFrame:
    """Candles from positional rows [ms, open, high, low, close, volume]; equal rows count once, conflicting ones are an error."""
    cols = [F.timestamp_millis(F.col("row")[0].cast("long")).cast("timestamp_ntz").alias("date"), *[F.col("row")[k].cast("double").alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)]]
    own = rows.select(*cols).dropDuplicates()
    twice = own.groupBy("date").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"conflicting candles at {twice['date']}")
    return own


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON lines. Malformed lines and lines that are no object are left out, or an error if strict."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("value").alias("v"))
    good = F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit("malformed JSON line")).cast("boolean"))
    return parsed.where(good).select("x.*")


def json_document(spark: SparkSession, path: str, schema: str, most: int = 32 << 20) -> DataFrame:
    """Whole JSON documents with the SHA-256 of their bytes. One that is larger than `most` bytes or no JSON object is an error."""
    docs = spark.read.format("binaryFile").load(path)
    fits = F.when(F.col("length") <= most, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("document too large: "), "path")).cast("binary"))
    text = F.decode(fits, "UTF-8")
    whole = F.when(F.trim(text).startswith("{"), F.from_json(text, schema, {"mode": "FAILFAST"}))
    parsed = F.coalesce(whole, F.raise_error(F.concat(F.lit("no JSON object: "), "path")).cast(schema if schema.startswith("struct") else f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>"))
    return docs.select("path", F.sha2("content", 256).alias("sha256"), parsed.alias("document"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """pair, timeframe, rows, first, last, sha256 of candle files named PAIR-TIMEFRAME.feather."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    spans = candles_feather(spark, path).groupBy("path").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    name = r"([^/]+)-(\w+)\.feather$"
    return files.join(spans, "path").select(F.regexp_extract("path", name, 1).alias("pair"), F.regexp_extract("path", name, 2).alias("timeframe"), "rows", "first", "last", "sha256")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a JSON ledger; an unknown kind, a bad date or a missing id is an error."""
    own = spark.read.schema(LEDGER).option("multiLine", "true").json(path)
    twice = own.groupBy("id").count().where("id is not null and count > 1").first()
    if twice is not None:
        raise ValueError(f"ledger: trial {twice['id']} is there {twice['count']} times")
    bad = own.where(F.col("id").isNull() | ~F.col("kind").isin(KINDS) | F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).isNull() | F.col("counted").isNull()).first()
    if bad is not None:
        raise ValueError(f"ledger: bad trial {bad['id']}")
    return own


class SqliteSource(DataSource):
    """format("sqlite_snapshot"): a query of a database file, read in one read-only transaction. Options: path, query."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def schema(self) -> str:
        raise ValueError("give a schema: spark.read.format('sqlite_snapshot').schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.query = options["path"], options["query"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(self.query)


class JsonLinesStream(DataSource):
    """format("json_lines_tail"): lines of a growing file by byte offset. Options: path, and most lines a batch (batch).

    A line without its end is left for later; a file shorter than the offset is read again from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "json_lines_tail"

    def schema(self) -> str:
        return "line string, at long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options)


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", 50))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _lines(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        rows, at = [], start
        if not os.path.exists(self.path):
            return rows, at
        if os.path.getsize(self.path) < at:
            at = 0
        with open(self.path, "rb") as f:
            f.seek(at)
            while (len(rows) < self.batch if end is None else at < end) and (line := f.readline()).endswith(b"\n"):
                at += len(line)
                try:
                    if isinstance(json.loads(line), dict):
                        rows.append((line.decode().strip(), at))
                except (ValueError, RecursionError):
                    pass
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._lines(start["at"], None)
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start["at"], end["at"])[0])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(JsonLinesStream)
