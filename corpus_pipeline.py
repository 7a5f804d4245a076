"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir), where docs is a scan of what the stage before has written, and returns a DataFrame;
all but the last return the columns of documents, and further ones as they are, whatever their names.

Defined results: a null or empty text has no words, so the quality rules reject it; a null doc_id is never labelled, comes last in
line dedup and is kept by near-dedup only where its class has no other; repeated rows are documents of their own until near-dedup
keeps one; ties are settled by doc_id, then by file and row number; a document that the mix takes twice is packed twice; an empty
table, or one of which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import lines, mixing, packing, quality, simhash
from tapeworks.llm.common import materialise
from tapeworks.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The model is fitted on the labelled rows among docs."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line comes near go, and documents of which nothing is left."""
    return _counted(lines.without_duplicates(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models, hash functions and a tokenizer have no SQL form; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
