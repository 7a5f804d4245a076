"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Each input partition sorts the distinct 48-bit fingerprints of its texts, deals them to owners and sends every owner a
   Golomb-Rice coded list. A fingerprint that a third of all rows share is sent once by each partition.
2. An owner decodes its lists and answers each with a bitmap: which of its values came from another list too.
3. The bitmaps go back, in row order, to the partitions. Only rows whose bit is set (suspects) have their text shuffled and
   compared byte by byte; the others are known to be alone.

Rows are known by their file and their number in it, which are the same at every reading, however Spark deals the files to tasks
(that changes with the cores there are). A list holds rows of one block of a file. What is no scan of Parquet files is written to
the shared folder first.

Defined results: null text counts as empty; empty texts equal each other; of repeated rows (same id, same text) one stays; a
null doc_id is the smallest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, placed, text_of

BITS = 48
#: Rows of a file that are coded together, and answered by one bitmap.
BLOCK = 1 << 18
#: Rows whose fingerprints an owner holds at most, on average.
OWNER_ROWS = 1 << 22


def golomb(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct integers as Rice parameter, unary quotients and packed remainders of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(1, int(np.log2(max(2.0, 0.69 * float(gaps.mean())))))
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(stops[-1] + 1, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def ungolomb(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    return np.cumsum((quotient << np.uint64(k)) | bits @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)))


_SENT = "owner int, part string, block int, start long, n int, k int, unary binary, rest binary, rows binary, at binary, twice binary"


def _coded(owners: int):
    def send(part: str, block: int, seq: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = (fp % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((fp, owner))
        edges = np.flatnonzero(np.diff(owner[order], prepend=-1))
        out = []
        for own in np.split(order, edges[1:]):
            values, at, counts = np.unique(fp[own], return_inverse=True, return_counts=True)
            k, unary, rest = golomb(values)
            out.append((int(owner[own[0]]), part, block, int(seq[0]), len(values), k, unary, rest, (seq[own] % BLOCK).astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), np.packbits(counts > 1).tobytes()))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[x.split()[0] for x in _SENT.split(", ")]).astype({c: "int32" for c in ("owner", "block", "n", "k")}))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at: tuple[str, int] | None = None
        for b in batches:
            files = b.column("part").dictionary_encode()
            names, of = files.dictionary.to_pylist(), np.asarray(files.indices)
            every, prints = b.column("seq").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            block = every // BLOCK
            for run in np.split(np.arange(len(every)), np.flatnonzero((np.diff(of) != 0) | (np.diff(block) != 0)) + 1):
                if not len(run):
                    continue
                here = names[of[run[0]]], int(block[run[0]])
                if here != at and held:
                    yield from send(*at, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                at = here
                held.append((every[run], prints[run]))
        if held:
            yield from send(*at, *map(np.concatenate, zip(*held, strict=True)))

    return coded


def _answered(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's answer: for each list a bitmap of the values that another list holds too."""
    decoded = [ungolomb(r.n, r.k, r.unary, r.rest) for r in lists.itertuples()]
    every = np.sort(np.concatenate(decoded))
    twice = every[1:][every[1:] == every[:-1]]
    return lists[["owner", "part", "block", "start"]].assign(bits=[np.packbits(np.isin(v, twice)).tobytes() for v in decoded])


def _gathered(answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to one block as 64-bit words in row order; no row if nothing in it is suspect."""
    words = np.zeros(BLOCK // 64, np.uint64)
    for r in answers.itertuples():
        suspect = np.unpackbits(np.frombuffer(r.bits, np.uint8) | np.frombuffer(r.twice, np.uint8)).astype(bool)
        rows = np.frombuffer(r.rows, np.int32)[suspect[np.frombuffer(r.at, np.int32)]].astype(np.uint64)
        np.bitwise_or.at(words, (rows >> np.uint64(6)).astype(np.int64), np.uint64(1) << (rows & np.uint64(63)))
    last = int(np.flatnonzero(words)[-1]) + 1 if words.any() else 0
    out = answers[["part", "block"]].head(int(words.any()))
    return out.assign(words=pd.Series([words[:last].view(np.int64)] * len(out), index=out.index, dtype=object))


def suspects(docs: DataFrame) -> DataFrame:
    """doc_id, body, part and seq (a row's file and number), and whether another row has the same fingerprint."""
    rows = placed(docs.select("doc_id", "text"), "part", "seq").select(F.col("doc_id").cast("long"), text_of().alias("body"), "part", "seq")
    owners = max(partitions(docs.sparkSession), rows.count() // OWNER_ROWS)
    prints = rows.select("part", "seq", F.shiftrightunsigned(F.xxhash64("body"), 64 - BITS).alias("fp"))
    sent = materialise(prints.mapInArrow(_coded(owners), _SENT), "exact-lists")
    answers = sent.select("owner", "part", "block", "start", "n", "k", "unary", "rest").groupBy("owner").applyInPandas(_answered, "owner int, part string, block int, start long, bits binary")
    back = sent.select("owner", "part", "block", "start", "rows", "at", "twice").join(answers, ["owner", "part", "block", "start"])
    bitmaps = materialise(back.groupBy("part", "block").applyInPandas(_gathered, "part string, block int, words array<long>"), "exact-bitmaps")
    at = F.col("seq") % BLOCK
    word = F.get("words", (at / 64).cast("int"))
    bit = F.coalesce(F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    block = (F.col("seq") / BLOCK).cast("int")
    # small bitmaps are broadcast by Spark's own size check; larger ones are joined by a shuffle
    return rows.withColumn("block", block).join(bitmaps, ["part", "block"], "left").select("doc_id", "body", "part", "seq", bit.alias("suspect"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    flagged = suspects(docs)
    sha = F.sha2("body", 256).alias("text_sha256")
    alone = flagged.where(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    pairs = flagged.where("suspect")
    row = F.struct("part", "seq")
    last = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), "part", "seq")).alias("last")
    bodies = pairs.groupBy(sha, "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), last)
    one = F.when(F.count("*") == 1, F.max("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    groups = bodies.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), one.alias("group_size"), F.max("last").alias("last"))
    groups = groups.select("text_sha256", "keep_id", "group_size", F.struct("last.part", "last.seq").alias("keep_row"))
    members = pairs.select("doc_id", row.alias("row"), sha).join(groups, "text_sha256")
    return alone.unionByName(members.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


#: The same in DuckDB.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
