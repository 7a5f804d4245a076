"""WARC archives and their Merkle fixity audit.

Records are laid end to end by page id, ARCHIVE records' worth of ids to an archive. A leaf of the tree is a record: its
SHA-256 and the range of offsets it takes. Above it is a node for each page id (repeated ids meet there, in an
order-free sum), then one for each FANOUT neighbours, up to a single root. Two replicas are compared from their roots down; only
the children of differing nodes are joined on the next level, so an audit of sound replicas reads one row.

Defined results: null html and url are empty; line breaks in a url are percent-encoded; a null page id is -1 (nodes are numbered
from it); repeated rows are records of their own, and an id's records are laid out by their SHA-256 in parts, so that no window
holds all of an id; empty tables are equal trees without nodes, and against an empty replica every record is missing; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

ARCHIVE = 4096
FANOUT_BITS = 4
#: Pages carry no time of their own; all records state this one.
DATE = "1970-01-01T00:00:00Z"


def as_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record: html without the head of a response."""
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url]
    return F.concat(*head, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, record."""
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    return pages.select(page_id.alias("page_id"), as_record(page_id, F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """One folder archive=N with one file for each archive, records in order of page id."""
    own = records(pages).withColumn("archive", F.floor(F.col("page_id") / ARCHIVE))
    line = F.substr("record", F.lit(1), F.length("record") - 1).alias("record")  # its last byte is the writer's line end
    own.repartition("archive").sortWithinPartitions("archive", "page_id", "record").select("archive", line).write.partitionBy("archive").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive, record_offset, page_id, url, html of all records of files that write_warc has written."""

    def parsed(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in files:
            for name, data in zip(some["path"], some["content"], strict=True):
                rows, at = [], 0
                while at < len(data):
                    body = data.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(": ", 1) for line in data[at:body].decode().strip().split("\r\n")[1:])
                    end = body + int(fields["Content-Length"])
                    rows.append((int(name.split("archive=")[1].split("/")[0]), at, int(fields["WARC-Record-ID"][10:-1]), fields["WARC-Target-URI"], data[body:end].decode()))
                    at = end + 4
                yield pd.DataFrame(rows, columns=["archive", "record_offset", "page_id", "url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(parsed, "archive long, record_offset long, page_id long, url string, html string")


def leaves(own: DataFrame) -> DataFrame:
    """page_id, k, archive, record_offset, length, sha256 of records (page_id, record); k numbers repeated ids.

    Offsets and numbers are sums over the (id, first byte of SHA-256) parts before, then over the records inside a part.
    """
    part = ["archive", "page_id", "part"]
    slim = own.select("page_id", F.floor(F.col("page_id") / ARCHIVE).alias("archive"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    slim = slim.withColumn("part", F.substring("sha256", 1, 2))
    inside = Window.partitionBy(*part).orderBy("sha256").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumns({"inside": F.coalesce(F.sum("length").over(inside), F.lit(0)), "nth": F.row_number().over(Window.partitionBy(*part).orderBy("sha256"))})
    sums = slim.groupBy(*part).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))
    before = Window.partitionBy("archive").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    own_id = Window.partitionBy("archive", "page_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(own_id), F.lit(0)).alias("first"))
    both = slim.join(sums, part)
    return both.select("page_id", (F.col("first") + F.col("nth")).alias("k"), "archive", (F.col("start") + F.col("inside")).alias("record_offset"), "length", "sha256")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (node, hash) from the page ids up to one root."""
    end = F.col("record_offset") + F.col("length")
    mark = F.xxhash64("k", "sha256", "record_offset", end)
    sums = leaf.groupBy((F.col("page_id") + 1).alias("node")).agg(F.count("*").alias("n"), F.bit_xor(mark).alias("a"), F.sum(mark.cast("decimal(20,0)")).alias("b"), F.min("record_offset").alias("start"), F.max(end).alias("end"))
    level = materialise(sums.select("node", F.sha2(F.concat_ws(":", "n", "a", "b", "start", "end"), 256).alias("hash"), "start", "end"), "merkle")
    levels = [level]
    while level.limit(2).count() > 1:
        child = F.struct("node", "hash", "start", "end")
        up = level.groupBy(F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.min("start").alias("start"), F.max("end").alias("end"))
        parts = F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"], c["start"], c["end"]))
        level = materialise(up.select("node", F.sha2(F.array_join(parts, "|"), 256).alias("hash"), "start", "end"), "merkle")
        levels.append(level)
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records (page_id, record) that differ: status altered, moved, missing or extra, and where they lie in the primary or replica."""
    mine, theirs = materialise(leaves(primary), "leaves"), materialise(leaves(replica), "leaves")
    a, b = tree(mine), tree(theirs)
    depth = max(len(a), len(b))
    bad = None
    for k in range(depth - 1, -1, -1):
        x, y = (t[min(k, len(t) - 1)].select("node", "hash") if k < len(t) else t[-1].select("node", "hash").limit(0) for t in (a, b))
        if bad is not None:
            parent = F.shiftrightunsigned("node", FANOUT_BITS)
            x, y = (t.withColumn("parent", parent).join(bad, "parent", "left_semi").drop("parent") for t in (x, y))
        if len(a) > k and len(b) > k:
            differ = x.join(y.withColumnRenamed("hash", "other"), "node", "full_outer").where(~F.col("hash").eqNullSafe(F.col("other")))
        else:  # one tree has fewer levels: everything below is compared
            differ = x.unionByName(y)
        bad = materialise(differ.select(F.col("node").alias("parent")).distinct(), "merkle-bad")
    bad = bad.select((F.col("parent") - 1).alias("page_id"))
    x, y = (t.join(bad, "page_id", "left_semi") for t in (mine, theirs))
    y = y.select("page_id", "k", *[F.col(c).alias(f"their_{c}") for c in ("archive", "record_offset", "length", "sha256")])
    both = x.join(y, ["page_id", "k"], "full_outer")
    status = F.when(F.col("their_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("their_sha256"), "altered").when(F.col("record_offset") != F.col("their_record_offset"), "moved")
    place = [F.coalesce(c, f"their_{c}").alias(c) for c in ("archive", "record_offset", "length")]
    return both.select("page_id", *place, status.alias("status"), "sha256", F.col("their_sha256").alias("replica_sha256")).where("status is not null")


def damaged(own: DataFrame) -> DataFrame:
    """A replica with planted faults: one letter changed in every 50th record, every 1000th record lost."""
    changed = F.when(F.pmod("page_id", F.lit(50)) == 7, F.overlay("record", F.lit("#"), F.lit(6), F.lit(1))).otherwise(F.col("record"))
    return own.where(F.pmod("page_id", F.lit(1000)) != 123).withColumn("record", changed)


#: The audit of damaged() in DuckDB, without trees.
SQL = r"""
WITH own AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages
), other AS (
  SELECT page_id, CASE WHEN page_id % 50 = 7 THEN record[1:5] || '#' || record[7:] ELSE record END AS record FROM own WHERE page_id % 1000 <> 123
), x AS (
  SELECT page_id, page_id // 4096 AS archive, coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset, strlen(record) AS length, sha256(record) AS sha256 FROM own
), y AS (
  SELECT page_id, coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset, sha256(record) AS sha256 FROM other
)
SELECT x.page_id, x.archive, CAST(x.record_offset AS BIGINT) AS record_offset, x.length, x.sha256, y.sha256 AS replica_sha256,
  CASE WHEN y.sha256 IS NULL THEN 'missing' WHEN x.sha256 <> y.sha256 THEN 'altered' ELSE 'moved' END AS status
FROM x LEFT JOIN y USING (page_id) WHERE y.sha256 IS NULL OR x.sha256 <> y.sha256 OR x.record_offset <> y.record_offset
"""
