"""SimHash near-dedup over sharded vantage-point trees.

A fingerprint has a bit set where over half the XXH64 hashes (seed 42) of a text's 4-word shingles have it. Two are linked at
`radius` or fewer differing bits; classes are what links reach.

Search: the 64 bits are cut into BLOCKS blocks. A pair within `radius` leaves at least BLOCKS - radius blocks untouched, so it
agrees on all bits of one of the masks that join as many blocks. For each mask there is a tree of vantage points over the
distance between masked fingerprints. A pair that agrees on the mask is equally far from every vantage point, so these trees
have no borders to overlap; beyond the depth that the sample allows, a hash of the masked bits splits shards on. Where a shard stays too large though its masked bits are alike, the tree goes on with vantage
points over all 64 bits, and a fingerprint beyond a border but within `radius` of it is queried in both shards. Inside a
shard, points at a masked distance above zero are pruned; runs of equal masked bits go down a local tree over all 64 bits,
whose triangle bound prunes again, and its leaves are compared directly.

The trees come from a bounded sample of the fingerprints (SAMPLE rows); every fingerprint is routed through them. Equal
fingerprints are one point. A shard reports its links as a forest (each point with the smallest point its shard's links reach),
so a cluster of m near copies costs m rows.

Defined results: null and empty texts, and texts without words, have fingerprint zero, linked like any other; null ids are
never the smallest unless alone; repeated rows share a class; an empty table gives no rows; further columns are ignored by
near_duplicates() and returned by keep_first().
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, placed
from .graph import components
from .textbatch import FEW, chunks, mixed

RADIUS = 4
WORDS = 4
BLOCKS = 6
SAMPLE = 20_000
#: Points that a shard is meant to hold, and a local tree's leaf.
SHARD = 20_000
LEAF = 1024


def _fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    sizes, hashes = [], []
    for text in texts:
        w = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces only
        if len(w) < words:
            own = [digest(b" ".join(w), 42)] if w else []
        else:
            line = memoryview(b" ".join(w))
            ends = list(itertools.accumulate(map(len, w), lambda a, n: a + n + 1, initial=-1))[1:]
            own = [digest(line[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :], strict=False)]
        sizes.append(len(own))
        hashes += own
    out, at = np.zeros(len(texts), np.uint64), 0
    every = np.array(hashes, np.uint64)
    for i, n in enumerate(sizes):
        if n:
            ones = np.zeros(64, np.int64)
            for k in range(at, at + n, 1 << 14):
                ones += np.unpackbits(every[k : min(at + n, k + (1 << 14))].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > n).view(">u8")[0]
            at += n
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and any further columns of docs but text."""
    own = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=FEW):
                fp = _fingerprints(pc.cast(part.column("text"), pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *map(part.column, own)], ["doc_id", "fp", *own])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *own)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(made, f"doc_id long, fp long{kinds}")


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Joins of blocks - radius blocks of bits; a pair within radius agrees on all bits of one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(block, blocks - radius)]


def _tree(sample: np.ndarray, mask: np.uint64, scale: float, radius: int, shard: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (vantage, mask, border, slack, near, far); a child below 0 is shard -child - 1. scale: points a sampled one stands for."""
    nodes: list[tuple] = []
    shards = itertools.count(1)

    def grow(own: np.ndarray, depth: int) -> int:
        if len(own) * scale <= shard or len(own) < 16 or depth > 40:
            return -next(shards)
        for kind, slack in ((mask, 0), (np.uint64(2**64 - 1), radius)):
            for vantage in rng.choice(own, min(4, len(own)), replace=False):
                d = np.bitwise_count((own ^ vantage) & kind).astype(int)
                border = int(np.median(d))
                if (d <= border).all():
                    border -= 1
                near, far = own[d <= border + slack], own[d > border]
                if 0 < len(near) and 0 < len(far) and max(len(near), len(far)) < 0.95 * len(own):
                    k = len(nodes)
                    nodes.append(())
                    nodes[k] = (vantage, kind, border, slack, grow(near, depth + 1), grow(far, depth + 1))
                    return k
        return -next(shards)

    grow(sample, 0)
    return nodes


def _routed(tree: list[tuple], fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of the fingerprints that are queried there)."""
    todo = [(0 if tree else -1, np.arange(len(fp)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            yield -node - 1, at
        elif len(at):
            vantage, mask, border, slack, near, far = tree[node]
            d = np.bitwise_count((fp[at] ^ vantage) & mask).astype(int)
            todo += [(near, at[d <= border + slack]), (far, at[d > border])]


def _pairs(fp: np.ndarray, mask: np.uint64, radius: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within radius that agree on the mask: runs of equal masked bits, short ones side by side."""
    order = np.argsort(fp & mask, kind="stable")
    cell = (fp & mask)[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    for k in np.flatnonzero(sizes > leaf):
        own = order[starts[k] : starts[k] + sizes[k]]
        for a, b in _tree_pairs(fp[own], radius, leaf):
            yield own[a], own[b]
    short = np.repeat(sizes, sizes) <= leaf
    order, cell = order[short], cell[short]
    live, lag = np.arange(len(order)), 1
    while len(live):
        live = live[live + lag < len(order)]
        live = live[cell[live] == cell[live + lag]]
        close = live[np.bitwise_count(fp[order[live]] ^ fp[order[live + lag]]) <= radius]
        if len(close):
            yield order[close], order[close + lag]
        lag += 1


def _tree_pairs(fp: np.ndarray, radius: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within radius, each at least once: a local vantage-point tree, leaves compared directly."""
    rng = np.random.default_rng(len(fp))
    todo = [(np.arange(len(fp)), 0)]
    while todo:
        at, failed = todo.pop()
        if len(at) < 2:
            continue
        if len(at) > leaf and failed < 3:
            d = np.bitwise_count(fp[at] ^ fp[rng.choice(at)]).astype(int)
            border = int(np.median(d))
            near, far = at[d <= border + radius], at[d > border]
            # a pair across the border has its far end within radius of it: near, widened by the radius, holds both ends
            if len(near) < 0.9 * len(at):
                todo += [(near, 0), (far, 0)]
            else:
                todo.append((at, failed + 1))
            continue
        step = max(1, (1 << 20) // len(at))
        for k in range(0, len(at), step):
            i, j = np.nonzero(np.bitwise_count(fp[at[k : k + step], None] ^ fp[None, at]) <= radius)
            keep = at[i + k] < at[j]
            if keep.any():
                yield at[i + k][keep], at[j][keep]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> np.ndarray:
    """For each of n positions the smallest one that pairs reach. About `most` pairs are held at a time, none that says nothing new."""
    label, held, size = np.arange(n), [], 0
    for a, b in pairs:
        a, b = label[a], label[b]
        new = a != b
        if new.any():
            held.append((a[new], b[new]))
            size += int(new.sum())
        if size > most:
            label, held, size = _joined(label, held), [], 0
    return _joined(label, held)


def _joined(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """label, where each position has its smallest one, after pairs of such labels are linked too."""
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b, old[a], old[b]):
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == old).all():
            return label


def similar_links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """a, b: for distinct fingerprints (points: fp), links whose components are those of all pairs within radius."""
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    scale = max(1.0, points.count() / max(1, len(sample)))
    rng = np.random.default_rng(1)
    forest = [_tree(sample, np.uint64(m), scale, radius, shard, rng) for m in masks(blocks, radius)]
    parts = max(1, int(16 * scale / shard))  # a sample splits no shard of fewer than 16 of its points

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for k, (mask, tree) in enumerate(zip(masks(blocks, radius), forest, strict=True)):
                part = (mixed(fp.view(np.uint64) & np.uint64(mask)) % np.uint64(parts)).astype(np.int32)  # pairs agree on the mask
                for shard_no, at in _routed(tree, fp.view(np.uint64)):
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), shard_no, np.int32)), pa.array(part[at]), pa.array(fp[at])], ["tree", "shard", "part", "fp"])

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        fp, mask = np.sort(group["fp"].to_numpy()), np.uint64(masks(blocks, radius)[group["tree"].iloc[0]])
        root = _forest(len(fp), _pairs(fp.view(np.uint64), mask, radius, LEAF))
        own = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[root[own]], "b": fp[own]})

    return points.select("fp").mapInArrow(routed, "tree int, shard int, part int, fp long").groupBy("tree", "shard", "part").applyInPandas(linked, "a long, b long")


def _classified(docs: DataFrame, radius: int, words: int) -> DataFrame:
    """doc_id, fp, component (a fingerprint), component_id, and any further columns of docs but text."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    reached = components(similar_links(points, radius))
    classes = points.join(reached, points["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialise(classes.join(least, "component").select("fp", "component", "component_id"), "classes")
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    return _classified(docs.select("doc_id", "text"), radius, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One document of each class, one with the smallest doc_id (of those the first by file and number), with all columns. What is
    no scan of Parquet files is written first."""
    file, at = fresh(docs, "file"), fresh(docs, "at")
    docs = placed(docs, file, at)
    own = docs.select("doc_id", "text", F.col(file).alias("file"), F.col(at).alias("at"))
    rank = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank")
    first = _classified(own, radius, words).groupBy("component").agg(F.min(F.struct(rank, "file", "at")).alias("first"))
    return docs.join(first.select(F.col("first.file").alias(file), F.col("first.at").alias(at)), [file, at], "left_semi").drop(file, at)
