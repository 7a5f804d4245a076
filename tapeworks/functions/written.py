"""Results that are read more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where a local session's own folder is noted.
_OWN = "tapeworks.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where none is set and Spark is one local process."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = f"file://{tempfile.mkdtemp(prefix='tapeworks-')}"
        spark.conf.set(_OWN, there)
    return there.rstrip("/")


#: Whether Spark deletes a query's shuffle files at the query's end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read back: it is worked out once, and a lost executor costs no recomputation. The shuffle files behind
    it are deleted once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeworks/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
