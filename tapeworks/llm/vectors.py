"""Vector code compression: product codes with codebooks that are refined in rounds of integer arithmetic.

A vector's components become integers, floor(4096 x), and the vector eight equal parts; each part position has a codebook. Each
round builds one kd-tree a codebook on the driver and broadcasts the eight of them (their size is that of the codebooks, whatever
the number of vectors). Tasks look up the nearest entry of each part by branch and bound: a branch is passed over only if its
bounding box is farther than the best entry so far, so that one equally far is still visited and the entry of the lower index
wins a tie. Tasks add up integers for each entry and component, Spark adds up the tasks, and the driver divides: order of rows and
tasks doesn't matter, and a task that runs twice gives the same sums.

Vectors are read anew in each round and never shuffled; only sums and, at the end, codes and errors are.

Defined results: rows whose vector is null or has a null or non-finite component are left out; a null vec_id is the largest, and
of rows with one vec_id the vector decides which starts a codebook; fewer than 16 rows give as many entries; shorter vectors, and
dimensions that eight doesn't divide, are filled up with zeros; an empty table gives no rows; further columns are ignored. An
error of 2^63 or more fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries in a leaf of a kd-tree.
LEAF = 4
#: Vectors looked up at once.
ROWS = 4096
#: Components below this, in at most 1,024 dimensions, give distances that 64 bits hold; others are Python's integers.
EXACT = 1 << 25


def kd_tree(points: np.ndarray, entries: np.ndarray | None = None) -> tuple:
    """A node: the box around its entries (low, high), and either their indexes in order, or None and two children.

    A node's entries are halved along the widest side, down to LEAF of them. Plain tuples, as a broadcast is unpickled without
    the package.
    """
    entries = np.arange(len(points)) if entries is None else entries
    own = points[entries]
    low, high = own.min(axis=0), own.max(axis=0)
    if len(entries) <= LEAF or not len(low) or (low == high).all():
        return low, high, np.sort(entries), None
    order = entries[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
    half = len(order) // 2
    return low, high, None, (kd_tree(points, order[:half]), kd_tree(points, order[half:]))


def _box_distance(node: tuple, x: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to a node's box."""
    gap = np.maximum(np.maximum(node[0] - x, x - node[1]), 0)
    return (gap * gap).sum(axis=1)


def nearest(tree: tuple, points: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of x; of equally near ones the lowest index."""
    best = np.full(len(x), len(points))
    least = np.full(len(x), np.iinfo(np.int64).max if x.dtype != object else 1 << 3000, x.dtype)

    def visit(node: tuple, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound <= least[rows]]  # equal bounds are visited
        if not len(rows):
            return
        _, _, entries, children = node
        if children is None:
            for e in entries:
                gap = x[rows] - points[e]
                d = (gap * gap).sum(axis=1)
                better = (d < least[rows]) | ((d == least[rows]) & (e < best[rows]))
                least[rows[better]] = d[better]
                best[rows[better]] = e
            return
        left, right = children
        a, b = _box_distance(left, x[rows]), _box_distance(right, x[rows])
        first = (a <= b).astype(bool)
        for near, child, other, own, rest in ((first, left, right, a, b), (~first, right, left, b, a)):
            visit(child, rows[near], own[near])
            visit(other, rows[near], rest[near])

    visit(tree, np.arange(len(x)), np.zeros(len(x), x.dtype))
    return best, least


def assign(entries: np.ndarray, trees: list[tuple], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry by row of x and part; entries by part, entry and component."""
    width = entries.shape[2]
    if entries.dtype == object:
        x = x.astype(object)
    found = [nearest(t, p.astype(x.dtype), x[:, k * width : (k + 1) * width]) for k, (t, p) in enumerate(zip(trees, entries, strict=True))]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in entries.ravel()).encode()).hexdigest()


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column as rows of integers, filled up with zeros to `dim`."""
    if isinstance(column, pa.FixedSizeListArray):
        column = column.cast(pa.list_(column.type.value_type))
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    big = len(flat) and np.abs(flat).max() >= EXACT
    flat = np.array([int(v) for v in flat], object) if big else flat.astype(np.int64)
    if (size == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), flat.dtype)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vector, label of the rows whose vector is whole and finite; a missing label column is null."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    v = F.col(vector)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), label.alias("label"))
    inf = F.lit(float("inf"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Integer entries by part, entry and component, for kept rows (vec_id, vector, ...); None without rows."""
    dim = rows.agg(F.max(F.size("vector"))).first()[0]
    if dim is None:
        return None
    width = -(-dim // parts)
    start = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    x = integers(start.column("vector").combine_chunks(), width * parts)
    books = np.stack([x[:, k * width : (k + 1) * width] for k in range(parts)])
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast((books, [kd_tree(p) for p in books]))

        def added(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books, trees = sent.value
            n, k, w = books.shape
            sums, counts = np.zeros((n, k, w), object), np.zeros((n, k), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = integers(batch.column("vector").slice(at, ROWS), n * w)
                    index, _ = assign(books, trees, x)
                    for part in range(n):
                        own = np.zeros((k, w), x.dtype)
                        np.add.at(own, index[:, part], x[:, part * w : (part + 1) * w])
                        sums[part] += own.astype(object)
                        counts[part] += np.bincount(index[:, part], minlength=k)
            used = np.argwhere(counts > 0)
            yield pa.RecordBatch.from_pylist([{"part": int(p), "entry": int(e), "n": int(counts[p, e]), "sums": [str(v) for v in sums[p, e]]} for p, e in used], _SUMS)

        tasks = rows.select("vector").mapInArrow(added, from_arrow_schema(_SUMS))
        # sums travel as decimal text and are added as decimals: at most parts x entries x width rows come back
        cells = tasks.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "sum"))
        total = cells.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum")).collect()
        now = books.astype(object)
        for r in total:
            if r["at"] is not None:
                now[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["n"]
        books = now.astype(np.int64) if all(abs(v) < EXACT for v in now.ravel()) else now
        sent.unpersist()
    return books




def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of kept rows (vec_id, vector, label)."""
    sent = rows.sparkSession.sparkContext.broadcast((books, [kd_tree(p) for p in books]))
    fields = f"vec_id long, code string, error long, label {rows.schema['label'].dataType.simpleString()}"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = integers(piece.column("vector"), books.shape[0] * books.shape[2])
                index, distance = assign(books, trees, x)
                width = max(2, len(f"{books.shape[1] - 1:x}"))
                code = ["".join(f"{i:0{width}x}" for i in row) for row in index.tolist()]
                error = pa.array([int(e) for e in distance.astype(object).sum(axis=1)], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(code, pa.string()), error, piece.column("label")], ["vec_id", "code", "error", "label"])

    return rows.mapInArrow(coded, fields)


def compress(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each vector that is kept."""
    rows = kept(vectors, vector)
    books = fit_codebooks(rows)
    empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return vectors.sparkSession.createDataFrame([], empty)
    coded = materialise(encode(rows, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("own_label")).agg(F.sum("error").alias("label_error"))
    with_label = coded.join(by_label, F.col("label").eqNullSafe(F.col("own_label")))
    return with_label.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB for vectors of one dimension that eight divides: rounds written out."""
    ctes = [
        "whole AS (SELECT vec_id, embedding, label, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT vec_id, entry, unnest(list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT))) AS x, unnest(range(len(embedding))) AS k, len(embedding) // {PARTS} AS width FROM whole)",
        "comps AS MATERIALIZED (SELECT vec_id, entry, k // width AS part, k % width AS pos, x FROM cells)",
        f"book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comps WHERE entry < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"far{r} AS (SELECT v.vec_id, v.part, b.entry, sum((v.x - b.c) * (v.x - b.c)) AS d FROM comps v JOIN book{r} b ON v.part = b.part AND v.pos = b.pos GROUP BY ALL)")
        ctes.append(f"near{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM far{r} GROUP BY ALL)")
        if r < ROUNDS:
            ctes.append(f"mean{r} AS (SELECT v.part, n.best.entry AS entry, v.pos, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS c FROM comps v JOIN near{r} n ON v.vec_id = n.vec_id AND v.part = n.part GROUP BY ALL)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)")
    ctes.append(f"codes AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)")
    return f"""
WITH {", ".join(ctes)}
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes c JOIN whole w ON c.vec_id = w.vec_id
"""


SQL = _sql()
