"""Vector codes against a plain version, on tables with nulls, ties, repeats, odd sizes and extreme values."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from tapeworks.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error, label_error, sha of rows (vec_id, vector, label) by exhaustive search over Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not rows:
        return []
    width = -(-max(len(r[1]) for r in rows) // parts)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = []
    for _, v, _ in rows:
        whole = [math.floor(4096 * float(np.float32(k))) for k in v] + [0] * (width * parts - len(v))
        x.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    books = [[v[p] for v in x[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in x:
                own[near(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for e, o in zip(books[p], own, strict=True)]
    found = [[near(p, v[p]) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, labels[r[2]], sha) for r, f, e in zip(rows, found, error, strict=True)]


def got(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vectors.compress(df).collect()), key=str)


def case(n, dim, seed, scale=1.0, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, scale, (n, dim)).astype(np.float32)
    if step:
        x = np.round(x / step) * step  # ties
    return [(int(i), [float(v) for v in row], None if i % 5 == 0 else int(i % 3)) for i, row in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(
    "rows",
    [
        case(300, 16, 1),
        case(300, 8, 2, step=0.5),
        case(10, 16, 3),
        case(60, 13, 4),
        [*case(60, 16, 5), (None, [0.5] * 16, None), (3, [0.25] * 16, 1), (3, [0.25] * 16, 1), (70, None, 1), (71, [None] * 16, 1), (72, [float("nan")] * 16, 2), (73, [float("inf")] * 16, 0), (74, [], 2), (75, [1.0, -1.0], 2)],
        [*case(40, 8, 6), (99, [2.0**15, -(2.0**15), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1)],
        [(k, [1.0] * 8, 1) for k in range(40)],
    ],
)
def test_codes_against_all_entries(spark, rows):
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_nothing_kept(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    assert vectors.compress(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_query_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    from tapeworks.llm import queries

    assert sorted(map(tuple, queries.op13_vector_codes(spark, "/root/testdata/sf0.001").collect())) == sorted(plain(rows))


def test_tree_keeps_the_lower_of_equal_entries():
    points = np.array(list(itertools.product(range(-2, 3), repeat=3)))[::-1].copy()
    points = np.concatenate([points, points])  # each twice
    x = np.random.default_rng(1).integers(-6, 7, (4000, 3))
    index, distance = vectors.nearest(vectors.kd_tree(points), points, x)
    every = ((x[:, None] - points) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_missing_label_column(spark):
    df = spark.createDataFrame([(k, [float(k)] * 8) for k in range(20)], "vec_id long, embedding array<double>")
    rows = vectors.compress(df).collect()
    assert len(rows) == 20 and {r["label_error"] for r in rows} == {sum(r["error"] for r in rows)}
