"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input is a hashed word vector, plus the mean of its hashed byte-trigram vectors, plus those of its first 3 to 6 bytes. Two gated recurrent layers read a
window in either direction, attention pools their states, a logistic unit scores the window. All overlapping windows of a
text are scored; the text's score is the largest, calibrated. The network is trained in numpy on a bounded sample of
labelled rows: in each round every window of the sample is scored, and of each row the highest one is learnt from (for label
0 a random one too), as a label holds for a text and not for each of its windows.

Defined results: null and empty texts are one window without words; null ids pass through and are in the training part;
repeated rows are scored alike; an empty table gives no rows; labels of one kind only give every text score 0; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import platt
from .common import materialise, split_words, text_of
from .textbatch import Texts, chunks, ragged

#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 64, 48
WORD_SLOTS, GRAM_SLOTS, STEM_SLOTS = 1 << 14, 1 << 13, 1 << 15
STEMS = (3, 4, 5, 6)
#: Texts that must hold a slot before its share among label 1 is taken at face value.
FAITH = 40
INPUT, HIDDEN, ATTEND = 12, 8, 8
#: Labelled rows trained on, the most, a third of them of label 1 if there are as many; and the words trained on, the most.
TRAIN_ROWS, TRAIN_WORDS = 3600, 4_000_000
THRESHOLD = 0.7
FOLD = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Params = dict[str, np.ndarray]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLD == 1, F.lit(False))


@dataclass
class Words:
    """The distinct words of a batch: slot of each, its stems' slots (0: none), its trigrams' end to end with their number; and `at`, each word's place."""

    slot: np.ndarray
    stems: np.ndarray
    grams: np.ndarray
    n_grams: np.ndarray
    at: np.ndarray
    n_words: np.ndarray


def words_in(column: pa.Array) -> Words:
    t = Texts(column)
    t.data = _LOWER[t.data]
    h, first, at = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
    starts, size = t.starts[first], (t.ends - t.starts)[first]
    edge = np.concatenate([[0], np.cumsum(size)])
    pos = np.repeat(starts - edge[:-1], size) + np.arange(edge[-1])
    b = np.concatenate([t.data, np.zeros(1, np.uint8)]).astype(np.uint32)
    left, right = b[pos - 1], b[pos + 1]
    left[edge[:-1]] = 32
    right[edge[1:] - 1] = 32
    gram = ((left * np.uint32(65599) + b[pos]) * np.uint32(65599) + right) * np.uint32(0x9E3779B1) >> np.uint32(19)
    stems, code = np.zeros((len(h), len(STEMS)), np.int64), np.zeros(len(h), np.uint32)
    for k in range(STEMS[-1]):
        code = code * np.uint32(0x01000193) + b[np.minimum(starts + k, len(b) - 1)] + np.uint32(1)
        if k + 1 in STEMS:
            own = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(17)
            stems[:, STEMS.index(k + 1)] = np.where(size > k, np.maximum(own, 1), 0)
    return Words((h >> np.uint64(50)).astype(np.int64), stems, gram.astype(np.int64), size, at, t.n_words)


def inputs(p: Params, w: Words) -> np.ndarray:
    """The input vector of each distinct word, and zeros behind them for places without a word."""
    if not len(w.slot):
        return np.zeros((1, INPUT), np.float32)
    sums = np.add.reduceat(p["grams"][w.grams], np.concatenate([[0], np.cumsum(w.n_grams)[:-1]]), axis=0)
    stems = p["stems"][w.stems].sum(axis=1)
    return np.concatenate([p["words"][w.slot] + sums / w.n_grams[:, None] + stems, np.zeros((1, INPUT), np.float32)]).astype(np.float32)


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (index into inputs(), -1 without a word) of each window, and the row it belongs to; each row has one at least."""
    n = np.maximum(1, -(-(w.n_words - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    first = np.cumsum(w.n_words) - w.n_words
    inside = place < w.n_words[row][:, None]
    at = np.append(w.at, -1)
    return np.where(inside, at[np.where(inside, first[row][:, None] + place, -1)], -1), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows. x: (N, WINDOW, INPUT); mask: 1 where there is a word."""
    n, steps = mask.shape
    states, kept = np.empty((n, steps, 2 * HIDDEN), np.float32), {}
    for d in (0, 1):
        xp = x @ p[f"w{d}"] + p[f"b{d}"]
        u, h = p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            zr = _sigmoid(xp[:, t, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN] * mask[:, t, None], zr[:, HIDDEN:]
            c = np.tanh(xp[:, t, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            if keep:
                kept[d, t] = (h, z, r, c)
            h = h + z * (c - h)
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
    a = np.tanh(states @ p["wa"])
    e = np.where(mask > 0, a @ p["va"], -1e9)
    s = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    s = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.einsum("nt,nth->nh", s, states)
    kept |= {"states": states, "a": a, "s": s, "pooled": pooled} if keep else {}
    return pooled @ p["wo"] + p["bo"][0], kept


def backward(p: Params, x: np.ndarray, mask: np.ndarray, kept: dict, g: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters and of x, from those of the logits."""
    states, a, s, pooled = kept["states"], kept["a"], kept["s"], kept["pooled"]
    out: Params = {"wo": pooled.T @ g, "bo": np.array([g.sum()])}
    gp = g[:, None] * p["wo"]
    gs = np.einsum("nh,nth->nt", gp, states)
    ge = s * (gs - (gs * s).sum(axis=1, keepdims=True))
    ga = ge[:, :, None] * p["va"] * (1 - a * a)
    out["va"], out["wa"] = np.einsum("nt,nta->a", ge, a), np.einsum("nth,nta->ha", states, ga)
    g_states = s[:, :, None] * gp[:, None] + ga @ p["wa"].T
    gx, steps = np.zeros_like(x), mask.shape[1]
    for d in (0, 1):
        u, gh = p[f"u{d}"], np.zeros((len(x), HIDDEN), np.float32)
        gu, gxp = np.zeros_like(u), np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, c = kept[d, t]
            gh = gh + g_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            gz = gh * (c - h) * z * (1 - z) * (mask[:, t, None] > 0)
            gc = gh * z * (1 - c * c)
            grh = gc @ u[:, 2 * HIDDEN :].T
            gr = grh * h * r * (1 - r)
            gzr = np.concatenate([gz, gr], axis=1)
            gu[:, : 2 * HIDDEN] += h.T @ gzr
            gu[:, 2 * HIDDEN :] += (r * h).T @ gc
            gxp[:, t] = np.concatenate([gzr, gc], axis=1)
            gh = gh * (1 - z) + grh * r + gzr @ u[:, : 2 * HIDDEN].T
        out[f"u{d}"], out[f"w{d}"], out[f"b{d}"] = gu, np.einsum("nti,ntk->ik", x, gxp), gxp.sum(axis=(0, 1))
        gx += gxp @ p[f"w{d}"].T
    return out, gx


@dataclass(frozen=True)
class ToxicityModel:
    params: Params
    slope: float = 1.0
    shift: float = 0.0
    constant: bool = False


def logits(p: Params, column: pa.Array) -> np.ndarray:
    """Of each text the largest logit of its windows."""
    w = words_in(column)
    x, (place, row) = inputs(p, w), windows(w)
    out = np.concatenate([forward(p, x[part], (part >= 0).astype(np.float32))[0] for part in np.array_split(place, max(1, len(place) // 2000))])
    return np.maximum.reduceat(out, np.flatnonzero(np.diff(row, prepend=-1))) if len(row) else out


def _start(rng: np.random.Generator, w: Words, y: np.ndarray, learn: np.ndarray) -> Params:
    """Random weights; one coordinate of a slot's vector is how much likelier a text of label 1 holds it, of the texts to learn from."""
    p = {"words": rng.normal(0, 0.05, (WORD_SLOTS, INPUT)), "grams": rng.normal(0, 0.05, (GRAM_SLOTS, INPUT)), "stems": rng.normal(0, 0.02, (STEM_SLOTS, INPUT)), "wa": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "va": rng.normal(0, 0.3, ATTEND), "wo": rng.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1)}
    for d in (0, 1):
        p |= {f"w{d}": rng.normal(0, 0.4, (INPUT, 3 * HIDDEN)), f"u{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    doc = np.repeat(np.arange(len(y)), w.n_words)
    cuts = max(1, len(doc) // 100_000)
    for name, slots, places, to in (("words", w.slot[:, None], WORD_SLOTS, 0), ("stems", w.stems, STEM_SLOTS, 1)):
        held = np.concatenate([np.zeros(0, np.int64), *(np.unique(part[:, None] * np.int64(places) + slots[at]) for part, at in zip(np.array_split(doc, cuts), np.array_split(w.at, cuts), strict=True))])
        held = np.unique(held)
        ones, zeros = (np.bincount(held % places, ((y == k) & learn)[held // places], places) for k in (1, 0))
        odds = np.log((ones + 0.5) / ((y == 1) & learn).sum().clip(1)) - np.log((zeros + 0.5) / ((y == 0) & learn).sum().clip(1))
        p[name][:, to] = np.clip(odds, -1, 3) * np.minimum(1, (ones + zeros) / FAITH)
    p["stems"][0] = 0
    return {k: v.astype(np.float32) for k, v in p.items()}


def train(texts: pa.Array, y: np.ndarray, rounds: int = 5, seed: int = 5) -> ToxicityModel:
    """On whole texts and their labels; every fifth text calibrates."""
    rng, w = np.random.default_rng(seed), words_in(texts)
    place, row = windows(w)
    learn = np.arange(len(y)) % 5 != 0
    first = np.cumsum(np.bincount(row, minlength=len(y))) - np.bincount(row, minlength=len(y))
    p = _start(rng, w, y, learn)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    edge = np.concatenate([[0], np.cumsum(w.n_grams)])
    weight = np.where(y == 1, 0.5 / max(1, y[learn].sum()), 0.5 / max(1, (1 - y[learn]).sum())) * learn.sum()
    for turn in range(rounds):
        x = inputs(p, w)
        if turn:
            score = np.concatenate([forward(p, x[part], (part >= 0).astype(np.float32))[0] for part in np.array_split(place, max(1, len(place) // 2000))])
        else:  # before any training: the window with the likeliest word
            score = np.where(place >= 0, x[place][:, :, :2].max(axis=2), -9).max(axis=1)
        order = np.lexsort((-score, row))
        best = order[first]
        other = first + (rng.random(len(y)) * np.bincount(row, minlength=len(y))).astype(np.int64)
        chosen = np.concatenate([best[learn], other[learn & (y == 0)]])
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128)):
            step += 1
            used, at = np.unique(place[part], return_inverse=True)
            at = at.reshape(place[part].shape)
            live = used >= 0
            words = used[live]
            grams = w.grams[ragged(edge[words], w.n_grams[words])]
            vec = inputs(p, Words(w.slot[words], w.stems[words], grams, w.n_grams[words], at, w.n_words))
            xs = np.concatenate([vec[-1:], vec[:-1]])[at] if not live.all() else vec[at]
            mask = (place[part] >= 0).astype(np.float32)
            z, kept = forward(p, xs, mask, keep=True)
            g = (weight[row[part]] * (_sigmoid(z) - y[row[part]]) / len(part)).astype(np.float32)
            grads, gx = backward(p, xs, mask, kept, g)
            sums = np.zeros((len(used), INPUT), np.float32)
            np.add.at(sums, at.ravel(), gx.reshape(-1, INPUT))
            for k in ("words", "grams", "stems"):
                grads[k] = np.zeros_like(p[k])
            np.add.at(grads["words"], w.slot[words], sums[live])
            np.add.at(grads["stems"], w.stems[words].ravel(), np.repeat(sums[live], len(STEMS), axis=0))
            np.add.at(grads["grams"], grams, np.repeat(sums[live] / w.n_grams[words][:, None], w.n_grams[words], axis=0))
            grads["stems"][0] = 0
            for k, grad in grads.items():
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    out = logits(p, texts.filter(pa.array(~learn)))
    return ToxicityModel(p, *platt(out.astype(float), y[~learn]))


def _share(sizes: list[int], most: int) -> int:
    """The largest share of words with which texts of these sizes, each cut down to it, hold `most` words in all."""
    left, rest = most, sorted(sizes)
    for k, n in enumerate(rest):
        if n * (len(rest) - k) > left:
            return left // (len(rest) - k)
        left -= n
    return max(rest, default=0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_WORDS) -> ToxicityModel:
    """Trained on at most `rows` labelled rows outside the held-out part, by hash of their id, and on at most `most` words.

    Where the texts have more words, the longest give up some: they are trained on windows spread evenly over their whole length.
    """
    some = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).dropDuplicates(["doc_id"])
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    ones = some.where("toxic = 1").orderBy(*first).limit(rows // 3)
    some = F.broadcast(ones.unionByName(some.where("toxic = 0").orderBy(*first).limit(rows - rows // 3)))
    # one row an id, so that a repeated one comes to the driver once
    own = materialise(docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min(text_of()).alias("text")), "toxic-train")
    own = own.withColumn("words", split_words(F.col("text"))).withColumn("n", F.size("words"))
    share = max(WINDOW, _share([n for (n,) in own.select("n").collect()], most))  # at most `rows` numbers
    windows_ = F.lit(share // WINDOW - 1)
    place = F.sequence(F.lit(0), windows_)
    begin = lambda k: F.floor(k.cast("long") * (F.col("n") - WINDOW) / F.greatest(windows_, F.lit(1))).cast("int")
    spread = F.array_join(F.flatten(F.transform(place, lambda k: F.slice("words", begin(k) + 1, F.lit(WINDOW)))), " ")
    text = F.when(F.col("n") > share, spread).otherwise(F.col("text")).alias("text")
    own = own.select("doc_id", "toxic", text).toArrow().sort_by("doc_id").combine_chunks()
    y = own["toxic"].to_numpy().astype(int)
    if len(set(y[np.arange(len(y)) % 5 != 0].tolist())) < 2:
        return ToxicityModel({}, constant=True)
    return train(own["text"].chunk(0), y)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The columns of SCORES, one row for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                text = part.column("text")
                p = np.zeros(len(text)) if model.constant else _sigmoid(model.slope * logits(model.params, text).astype(float) + model.shift)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(rows, SCORES)
