"""The pipeline on the small tables: each stage against a plain version of its rule on the same input."""

import collections

import pytest

import corpus_pipeline
from tapeworks.llm import packing, quality

from .test_operators import plain_components, plain_fingerprint, plain_lines, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """What each stage reads, and what the last returns, as lists of rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs.collect())
        path = str(tmp_path_factory.mktemp("stage") / f"{k}.parquet")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs.collect()]


def test_columns_stay(written):
    assert all(rows[0].asDict().keys() == written[0][0].asDict().keys() for rows in written[:5])


def test_quality_stage(spark, written):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect() if r["kept"]}
    assert {r["doc_id"] for r in written[1]} == kept and len(written[1]) == len(kept)


def test_line_stage(written):
    gone = plain_lines([(r["doc_id"], r["text"], r["source"]) for r in written[1]])
    want = {}
    for r in written[1]:
        left = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[r["doc_id"]])
        if words(left):
            want[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in written[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in written[2])


def test_near_dedup_stage(written):
    import numpy as np

    ids = np.array([r["doc_id"] for r in written[2]])
    label = plain_components(np.array([plain_fingerprint(r["text"]) for r in written[2]], np.uint64))
    assert sorted(r["doc_id"] for r in written[3]) == sorted(ids[label == c].min() for c in set(label.tolist()))


def test_mixing_stage(written):
    times, before = collections.Counter(r["doc_id"] for r in written[4]), {r["doc_id"]: r for r in written[3]}
    assert max(times.values()) <= 3 and set(times) <= set(before)
    assert all(r["text"] == before[r["doc_id"]]["text"] for r in written[4])
    size = collections.Counter()
    for r in written[3]:
        size[r["source"]] += len(words(r["text"]))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    taken = collections.Counter()
    for r in written[4]:
        taken[r["source"]] += len(words(r["text"]))
    fair = sum(size.values()) / sum(weight.values())
    largest = max(len(words(r["text"])) for r in written[3])
    assert sum(taken.values()) <= sum(size.values())
    assert all(taken[s] <= 3 * size[s] for s in size) and all(taken[s] >= min(fair * weight[s], 3 * size[s]) - largest for s in size)


def test_packing_stage(written):
    fill = collections.Counter()
    for r in sorted(written[5], key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill[r["sequence_id"]] == r["offset"]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= packing.CAPACITY
    assert sum(r["piece"] == 0 for r in written[5]) == len(written[4])


def test_run_is_the_stages(spark, written):
    assert corpus_pipeline.run(spark, SF).count() == len(written[5])


@pytest.mark.parametrize("kept", ["all", "none"])
def test_odd_tables(spark, tmp_path, kept):
    """Nulls in every column, repeated rows, names that the stages use themselves; and an empty table."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = base.where("n_chars > 600").orderBy("doc_id").limit(40)
    odd = long.limit(6).withColumns({"doc_id": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    none = long.limit(2).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.lit(None).cast("string")})
    extra = {c: F.lit(k) for k, c in enumerate(("ROW", "file", "at", "times", "component", "__place", "__at", "kept", "toxic", "part"))}
    docs = long.unionByName(long.limit(5)).unionByName(odd).unionByName(none).withColumns(extra)
    docs = docs if kept == "all" else docs.where("false")
    docs.repartition(3).write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES):
            assert sorted(docs.columns) == sorted(names), name
            assert (docs.count() > 0) == (kept == "all"), name
            if kept == "all":
                assert all(r[c] == k for r in docs.collect() for k, c in enumerate(extra)), name
    assert (docs.count() > 0) == (kept == "all")
