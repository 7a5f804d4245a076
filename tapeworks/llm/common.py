"""What the operators of this subpackage share: scratch tables and the word rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WHITE_CLASS = r"[\x20\x09-\x0D]"


#: Where a local session's own folder is noted.
_OWN = "tapeworks.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where none is set and Spark is one local process."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = f"file://{tempfile.mkdtemp(prefix='tapeworks-')}"
        spark.conf.set(_OWN, there)
    return there.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tapeworks/{spark.sparkContext.applicationId}"


#: Whether Spark deletes a query's shuffle files at the query's end (left alone, they stay until its driver collects garbage), and how
#: many characters of a plan the driver keeps for each query it ran; a plan's constants are written out in it.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "50000"}


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    was = {k: spark.conf.get(k, None) for k in _TIDY}
    for k, v in _TIDY.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut, and a lost executor costs no recomputation. The
    shuffle files behind it are deleted as soon as it is written, so those of an operator's steps don't add up on disk."""
    spark = df.sparkSession
    path = f"{folder or _own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for tables that nothing reads after the block; they are deleted at its end."""
    folder = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        _delete(spark, folder)


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads files, picks columns and filters. How its rows are dealt to tasks may change from reading to reading."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.getClass().getSimpleName() == "LogicalRelation"


def pinned(df: DataFrame) -> DataFrame:
    """df, or a copy in the shared folder if df is no plain scan of files: each reading finds the same rows in the same files."""
    return df if is_scan(df) else materialise(df, "pinned")


def place_of(df: DataFrame) -> tuple[Column, Column]:
    """The file of a row of a scan of Parquet files, and the row's number in it: the same at every reading, however rows are dealt to tasks."""
    place = df.metadataColumn("_metadata")
    return place["file_path"], place["row_index"]


def placed(df: DataFrame, file: str = "__file", at: str = "__at") -> DataFrame:
    """df with the place of its rows (see place_of); what is no scan of Parquet files is written first."""
    df = pinned(df)
    try:
        return df.select("*", *[c.alias(n) for c, n in zip(place_of(df), (file, at), strict=True)])
    except AnalysisException:  # files of another kind
        df = materialise(df, "placed")
        return df.select("*", *[c.alias(n) for c, n in zip(place_of(df), (file, at), strict=True)])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result that reads them is needed any more."""
    _delete(spark, _own_dir(spark))


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def split_words(col: Column) -> Column:
    """array<string> of the words of a text, and empty ones. Texts whose only white space are spaces are split without a pattern, which is faster."""
    other = F.lit(False)
    for c in "\t\n\x0b\f\r":
        other = other | F.contains(col, F.lit(c))
    return F.when(other, F.split(col, WHITE_CLASS + "+")).otherwise(F.split(col, " "))


def words_of(col: Column) -> Column:
    """array<string> of the words of a text."""
    return F.array_remove(split_words(col), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
