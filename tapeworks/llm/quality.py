"""Quality rules: a calibrated logistic regression over hashed word and character n-grams.

Every text is scored whole, in Arrow batches. A document is kept if it passes two fixed base limits and the calibrated
probability of label 1 reaches a fixed threshold. Features are relative frequencies, so a text's length doesn't count.

Defined results: a null or empty text has no words and is rejected by the base limit; repeated rows are scored alike;
null and repeated ids pass through; an empty table gives no rows; a table without labels of both kinds gives a model
that keeps what the base limits keep; further columns are ignored by the scorer and returned by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import platt
from .textbatch import FEW, Texts, chunks, mixed

BITS = 15
#: Labelled rows the model is fitted on, the most; a fifth of them calibrates.
TRAIN_ROWS = 1500
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
THRESHOLD = 0.5
DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_KINDS = 4


@dataclass(frozen=True)
class QualityModel:
    """weights[k]: by hash, for n-grams of kind k; the calibrated logit is slope * score + shift."""

    weights: np.ndarray
    slope: float
    shift: float
    threshold: float = THRESHOLD


def _grams(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each kind (words, word pairs, 3 and 4 bytes): the slots in order of row, and how many each row has."""
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(40)
    w = t.word_hashes()
    pair = t.row[1:] == t.row[:-1]
    out = [((w >> shift) & mask, t.n_words)]
    out.append(((mixed(w[1:] * np.uint64(3) + w[:-1]) >> shift)[pair] & mask, np.maximum(t.n_words - 1, 0)))
    size = np.diff(t.off)
    b = t.data.astype(np.uint32)
    for n in (3, 4):
        h = np.zeros(max(0, len(b) - n + 1), np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        fits = np.ones(len(h), bool)
        for i in range(1, n):  # n-grams that would run into the next row
            cut = t.off[1:-1] - i
            fits[cut[(cut >= 0) & (cut < len(h))]] = False
        out.append((h[fits], np.bincount(np.searchsorted(t.off, np.flatnonzero(fits), "right") - 1, minlength=t.n) if (size < n).any() else size - n + 1))
    return out


def _raw_scores(t: Texts, weights: np.ndarray) -> np.ndarray:
    score = np.zeros(t.n)
    for k, (slots, counts) in enumerate(_grams(t)):
        sums = np.concatenate([[0.0], np.cumsum(weights[k][slots], dtype=np.float64)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        score += (sums[edge[1:]] - sums[edge[:-1]]) / np.maximum(counts, 1)
    return score


def _repeated(t: Texts) -> np.ndarray:
    """By row: words that lie in a window of WINDOW words which the same text holds twice or more."""
    w, n = t.word_hashes(), len(t.row) - WINDOW + 1
    if n <= 0:
        return np.zeros(t.n, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n + i]
    at = np.flatnonzero(t.row[:n] == t.row[WINDOW - 1 :])
    key = mixed(h[at] ^ mixed(t.row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(t.row) + 1, np.int64)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + WINDOW, -1)
    return np.bincount(t.row[np.cumsum(marks[:-1]) > 0], minlength=t.n)


def _repeated_lines(t: Texts) -> np.ndarray:
    """By row: lines with a word that equal an earlier line of the same text."""
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.off] = True
    feed = t.data == 10
    edge[1:][feed] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(t.data))
    ends = ends - (feed[ends - 1] if len(ends) else 0)
    full = np.add.reduceat(~t.space, starts) > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(t.off, starts, "right") - 1
    key = mixed(t.hashes(starts, ends) ^ mixed(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    return np.bincount(row[order[1:][key[order][1:] == key[order][:-1]]], minlength=t.n)


def _columns(t: Texts, model: QualityModel) -> list[np.ndarray]:
    repeat = _repeated(t)
    failed = (t.n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * t.n_words)
    p = 1 / (1 + np.exp(-np.clip(model.slope * _raw_scores(t, model.weights) + model.shift, -60, 60)))
    chars = t.per_row(~t.space & ((t.data & 0xC0) != 0x80))
    return [t.n_words, chars, t.per_row(_SYMBOL[t.data]), _repeated_lines(t), repeat, failed, p, ~failed & (p >= model.threshold)]


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 80) -> QualityModel:
    """Fit on at most `rows` labelled rows, those with the smallest hash of their id; sparse counts come to the driver."""
    some = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    some = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=FEW):
                t = Texts(part.column("text"))
                grams = [(s, np.concatenate([[0], np.cumsum(c)])) for s, c in _grams(t)]
                slots, values = [], []
                for i in range(t.n):
                    own = [np.unique(s[e[i] : e[i + 1]], return_counts=True) for s, e in grams]
                    slots.append(np.concatenate([u.astype(np.int32) + (k << BITS) for k, (u, _) in enumerate(own)]))
                    values.append(np.concatenate([(c / max(1, c.sum())).astype(np.float32) for _, c in own]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "quality", "slots", "shares"])

    # one row an id, so that a repeated one comes to the driver once
    own = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = own.mapInArrow(counted, "doc_id long, quality int, slots array<int>, shares array<float>").orderBy("doc_id").toArrow()
    y = got["quality"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros((_KINDS, 1 << BITS), np.float32), 1.0, 60.0)
    size = pc.list_value_length(got["slots"]).to_numpy().astype(np.int64)
    slots, shares = (pc.list_flatten(got[c]).to_numpy() for c in ("slots", "shares"))
    del got
    edge, weights = np.concatenate([[0], np.cumsum(size)]), np.zeros(_KINDS << BITS, np.float32)
    hold = np.arange(len(y)) % 5 == 0
    parts = [slice(a, min(a + 50, len(y))) for a in range(0, len(y), 50)]  # so many rows at a time, or driver memory grows

    def raw() -> np.ndarray:
        out = np.zeros(len(y))
        for p in parts:
            cells = slice(edge[p.start], edge[p.stop])
            row = np.repeat(np.arange(p.stop - p.start), size[p])
            out[p] = np.bincount(row, weights[slots[cells]] * shares[cells], minlength=p.stop - p.start)
        return out + bias

    def gradient(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(weights))
        for p in parts:
            cells = slice(edge[p.start], edge[p.stop])
            out += np.bincount(slots[cells], np.repeat(g[p], size[p]) * shares[cells], minlength=len(out))
        return out.astype(np.float32)

    yt = y[~hold]
    importance = np.where(hold, 0, np.where(y == 1, 0.5 / max(1, yt.sum()), 0.5 / max(1, (1 - yt).sum())) * len(yt))
    bias, m, v = 0.0, np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):  # Adam on the whole sample
        g = importance * (1 / (1 + np.exp(-raw())) - y) / len(yt)
        grad = gradient(g) + 1e-6 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights -= 1.0 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 2.0 * g.sum()
    slope, shift = platt(raw()[hold], y[hold])
    return QualityModel(weights.reshape(_KINDS, -1), slope, shift + slope * float(bias))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and the columns of DIGEST, one row for each document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=FEW):
                got = _columns(Texts(part.column("text")), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, got)], ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, f"doc_id long, {DIGEST}")


def filter_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=FEW):
                yield part.filter(pa.array(_columns(Texts(part.column("text")), model)[-1]))

    return docs.mapInArrow(kept, docs.schema)
