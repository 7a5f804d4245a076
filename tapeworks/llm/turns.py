"""Rows of conversations in order, cut into slices, and results that need a whole conversation.

Rows are dealt by ranges of (conversation, turn, role, beginning of the text), so that a conversation of any length is spread over
as many tasks as its rows fill, and each task reads its rows in order. A slice is worked on at once; conversations inside it are
whole, the first and the last one may go on in another slice and are marked open. Only open ones are sent on, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .textbatch import chunks

#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Characters of a text that take part in the ranges; rows alike in all of that stay in one task.
RANGE_CHARS = 32


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) with each task's in order by (conv_id, turn, role, text), nulls first; tasks follow each other."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The number of the task, the number of the slice, and the slice."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in chunks(batch, "text", SLICE):
            yield part, seq, piece
            seq += 1


def starts_of(piece: pa.RecordBatch) -> np.ndarray:
    """Where the conversations of a slice begin."""
    ids = piece.column("conv_id")
    value, known = np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_valid(ids))
    return np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1])


def _size(value: Any) -> int:
    """About how many characters a value holds."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_size, value.values()))
    return sum(map(_size, value)) if isinstance(value, list) else 0


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows, and of about SLICE characters of text."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += _size(r)
        if len(held) >= most or size > SLICE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


Batches = Iterator[pa.RecordBatch]


def folded(sources: list[tuple[DataFrame, Callable[[Batches], Batches]]], schema: pa.Schema, make: Callable[[], Any], result: pa.Schema) -> DataFrame:
    """One row (conv_id, result) a conversation of rows (conv_id, part, seq, open, ... by `schema`) that functions make of the sources.

    make() gives an object with add(row) and done(), a dict of the columns of `result`. Rows that aren't open are folded where
    they are, in the Python process that makes them. The others are sent to one task a conversation and folded as they come by,
    in order; none is held.
    """
    sent = pa.schema([*(f for f in schema if f.name != "open"), pa.field("done", pa.struct(list(result)))])
    out = pa.schema([pa.field("conv_id", pa.int64()), *result])

    def beside(source: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
        return lambda batches: near(source(batches))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                    for r in piece.to_pylist():
                        if r.pop("open"):
                            yield r | {"done": None}
                        else:
                            fold = make()
                            fold.add(r)
                            yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "done": fold.done()}

        yield from in_batches(each(), sent)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            at, fold = None, None
            for batch in batches:
                for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                    for r in piece.to_pylist():
                        if r["done"] is not None:
                            yield {"conv_id": r["conv_id"]} | r["done"]
                            continue
                        if fold is not None and r["conv_id"] != at:
                            yield {"conv_id": at} | fold.done()
                            fold = None
                        if fold is None:
                            at, fold = r["conv_id"], make()
                        fold.add(r)
            if fold is not None:
                yield {"conv_id": at} | fold.done()

        yield from in_batches(each(), out)

    parts = [df.mapInArrow(beside(f), from_arrow_schema(sent)) for df, f in sources]
    return reduce(DataFrame.unionByName, parts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(far, from_arrow_schema(out))
