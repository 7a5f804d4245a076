"""Class-based n-gram scoring (Brown): exchange clustering, class transitions and word emissions.

Training: word counts over all training texts; a bounded head of frequent words gets small codes; the other words of a text are
its tail, and codes point into it. A text is then a row of integers, and what follows works on those. Exchange clustering moves
one of the CLUSTER_WORDS most frequent words at a time to the class that raises the likelihood of class bigrams most; its
statistics (how often each word stands before and after each class) are gathered over all training texts in every round and
have a fixed size. Then every other word seen twice or more goes to the class that its neighbours over all training texts make
likeliest: a Spark job by word, whose result, like the counts, grows with the corpus and is joined by word. Words seen once
share a class.

Scoring: P(w | h) = WEIGHT * P(class of w | class before) * P(w | its class) + (1 - WEIGHT) * add-0.1 unigram. Both parts sum to
one over the vocabulary and one unknown word, so the score is a proper log-probability of the text and its end.

Defined results: null counts as empty, which is its end alone; unknown words get the unigram part and are a class without
counts; a null doc_id is in the training part; repeated rows count each; an empty table gives no rows; a table without
training texts scores by the unigram part alone; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .textbatch import chunks, laid_out, span_hashes

#: Words with a code of their own: the most frequent of at most HEAD_BYTES bytes. Bounds what the tasks are sent.
HEAD = 65_536
HEAD_BYTES = 64
#: Words that the exchange moves, classes it has, and rounds over the training texts.
CLUSTER_WORDS = 8192
CLASSES = 64
ROUNDS = 3
WEIGHT = 0.6
ADD = 0.1
END_CLASS, ONCE, UNKNOWN = CLASSES, CLASSES + 1, CLASSES + 2
ALL = CLASSES + 3
#: Stands for the end of a text in the table of counts; no word holds it.
END = "\n"
#: A task sends its counts of words after so many different ones.
SEEN = 100_000
_WORDS_A_BLOCK = 512


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; each task sends a sum for each word it has seen since its last sending."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for part in itertools.chain.from_iterable(map(chunks, batches)):
            seen[END.encode()] += part.num_rows
            for text in pc.cast(part.column("text"), pa.binary()).to_pylist():
                seen.update((text or b"").lower().split())
                if len(seen) > SEEN:
                    yield sent()
                    seen.clear()
        yield sent()

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encoded(docs: DataFrame, head: dict[bytes, int], folder: str | None = None) -> DataFrame:
    """row, doc_id, held_out, codes, tail: 0 is the end, head words follow by frequency, -1 - k is the k-th word of the row's tail."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in itertools.chain.from_iterable(map(chunks, batches)):
            codes, tails = [], []
            for text in pc.cast(part.column("text"), pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                code = np.fromiter(map(head.get, words, itertools.repeat(-1)), np.int32, len(words))
                miss = np.flatnonzero(code < 0)
                own: dict[bytes, int] = {}
                code[miss] = [-1 - own.setdefault(words[i], len(own)) for i in miss]
                codes.append(code)
                tails.append(list(own))
            out = [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(codes, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "held_out", "codes", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    return materialise(rows.mapInArrow(coded, "row long, doc_id long, held_out boolean, codes array<int>, tail array<string>"), "codes", folder)


def _resolved(coded: DataFrame, lexicon: DataFrame, folder: str) -> DataFrame:
    """doc_id, held_out, codes, and of each word of the tail its count and class."""
    tails = _found(coded, lexicon, folder)  # written, so that its shuffles are gone before the codes are shuffled
    return materialise(coded.drop("tail").join(tails, "row", "left").drop("row"), "resolved")


def _found(coded: DataFrame, lexicon: DataFrame, folder: str) -> DataFrame:
    """row, and of each word of its tail the count and the class; written."""
    tails = coded.select("row", F.posexplode("tail").alias("at", "word")).join(lexicon, "word", "left")
    found = F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(UNKNOWN)).alias("cls"))))
    tails = tails.groupBy("row").agg(found.alias("found")).select("row", F.transform("found", lambda x: x["n"]).alias("tail_n"), F.transform("found", lambda x: x["cls"]).alias("tail_class"))
    return materialise(tails, "tails", folder)


@dataclass(frozen=True)
class ClassModel:
    """head_counts and head_class by code; pairs[a, b]: how often class b follows class a; tokens and types in training."""

    head_counts: np.ndarray
    head_class: np.ndarray
    pairs: np.ndarray
    tokens: int
    types: int


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` tokens."""
    for b in batches:
        part = np.cumsum(np.asarray(pc.list_value_length(b.column("codes")), np.int64) + 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _strung(b: pa.RecordBatch, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch's texts, each with its end, behind one more end, where -1 - k is word k of all tails; and each text's tokens."""
    codes = b.column("codes")
    size, tails = (np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (codes, b.column(tail)))
    out, flat = np.zeros(size.sum() + len(size) + 1, np.int64), np.asarray(codes.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row + np.arange(size.sum()) + 1] = np.where(flat < 0, flat - (np.cumsum(tails) - tails)[row], flat)
    return out, size + 1


def _classes(b: pa.RecordBatch, model: ClassModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of codes or resolved ones: _strung(), and each token's count and class."""
    known = "tail_n" in b.schema.names
    seq, size = _strung(b, "tail_n" if known else "tail")
    tail, at = seq < 0, np.maximum(seq, 0)
    n, cls = model.head_counts[at], model.head_class[at]
    if known:
        n[tail], cls[tail] = (np.asarray(b.column(c).flatten())[-1 - seq[tail]] for c in ("tail_n", "tail_class"))
    else:
        n[tail], cls[tail] = 0, ONCE
    return seq, size, n, cls


def _summed(tables: DataFrame) -> DataFrame:
    """block, data: compressed tables of a block added up, first in about as many groups as make each sum as short as the last."""
    ways = 1 + math.isqrt(tables.rdd.getNumPartitions())

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(zlib.decompress(group["data"].iloc[0]), np.int64).copy()
        for data in group["data"].iloc[1:]:
            total += np.frombuffer(zlib.decompress(data), np.int64)
        return pd.DataFrame({"block": group["block"].head(1), "data": [zlib.compress(total.tobytes(), 1)]})

    first = tables.withColumn("way", F.spark_partition_id() % ways).groupBy("block", "way").applyInPandas(added, "block int, data binary")
    return first.groupBy("block").applyInPandas(added, "block int, data binary")


def _gathered(coded: DataFrame, model: ClassModel, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all training texts: class pairs, and for each code below `words` its followers' and leaders' classes and self-pairs."""
    blocks = -(-words // _WORDS_A_BLOCK)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, own = np.zeros(ALL * ALL, np.int64), np.zeros((blocks * _WORDS_A_BLOCK, 2 * ALL + 1), np.int64)
        for b in _parts(batches):
            seq, _, _, cls = _classes(b, model)
            pairs += np.bincount(cls[:-1] * ALL + cls[1:], minlength=ALL * ALL)
            for word, other, to in ((seq[:-1], cls[1:], 0), (seq[1:], cls[:-1], ALL)):
                live = (word >= 0) & (word < words)
                own[:, to : to + ALL] += np.bincount(word[live] * ALL + other[live], minlength=len(own) * ALL).reshape(-1, ALL)
            same = seq[:-1][(seq[:-1] == seq[1:]) & (seq[:-1] >= 0) & (seq[:-1] < words)]
            own[:, -1] += np.bincount(same, minlength=len(own))
        data = [zlib.compress(pairs.tobytes(), 1)] + [zlib.compress(x.tobytes(), 1) for x in (own.reshape(blocks, -1) if blocks else [])]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, blocks), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    tables = coded.where("not held_out").drop("row", "doc_id", "held_out").mapInArrow(counted, "block int, data binary")
    got = {r[0]: np.frombuffer(zlib.decompress(r[1]), np.int64) for r in _summed(tables).collect()}  # of a fixed size
    if not got:
        return np.zeros((ALL, ALL), np.int64), np.zeros((words, 2 * ALL + 1), np.int64)
    rows = [got[k].reshape(-1, 2 * ALL + 1) for k in range(blocks)]
    return got[-1].reshape(ALL, ALL), np.concatenate(rows)[:words] if rows else np.zeros((0, 2 * ALL + 1), np.int64)


def _transitions(pairs: np.ndarray) -> np.ndarray:
    """P(class b | class a), smoothed by the classes' shares."""
    n = pairs.sum(axis=0)
    return (pairs + n / max(1.0, n.sum())) / (pairs.sum(axis=1, keepdims=True) + 1)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, as longs."""
    data, off = laid_out(words)
    return span_hashes(data, off[:-1], off[1:]).view(np.int64)


def assigned_words(coded: DataFrame, names: list[bytes], model: ClassModel, moved: int) -> DataFrame:
    """hash, cls of all training words with a code from `moved` on or none: the class that its neighbours make likeliest.

    A word sends one byte for itself and for each neighbour that has a class: which class it is, and on which side. It goes by a
    hash of 64 bits; two words of one hash would share a class. names[k] is the word of code k.
    """
    side, own = END_CLASS + 1, 2 * (END_CLASS + 1)
    named = _word_hashes(pa.array(names, pa.binary()))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 1 << 20):  # the more tokens, the fewer rows a word sends
            seq, _, _, cls = _classes(b, model)
            tail = b.column("tail").flatten().dictionary_encode()
            at = np.flatnonzero((seq < 0) | (seq >= moved))
            word = np.where(seq[at] < 0, np.append(np.asarray(tail.indices), 0)[np.where(seq[at] < 0, -1 - seq[at], -1)], len(tail.dictionary) + seq[at])
            left, right = cls[at - 1], cls[np.minimum(at + 1, len(seq) - 1)]
            who = np.concatenate([word, word[left < side], word[right < side]])
            what = np.concatenate([np.full(len(at), own), left[left < side], side + right[right < side]]).astype(np.uint8)
            order = np.argsort(who, kind="stable")
            first = np.flatnonzero(np.diff(who[order], prepend=-1))
            hashes = np.concatenate([_word_hashes(tail.dictionary), named])[who[order[first]]]
            off = pa.array(np.append(first, len(order)).astype(np.int32))
            told = pa.Array.from_buffers(pa.binary(), len(first), [None, off.buffers()[1], pa.py_buffer(what[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), told], ["hash", "told"])

    with np.errstate(divide="ignore"):
        after = np.log(_transitions(model.pairs.astype(float)))
        table = np.zeros((own + 1, CLASSES))
        table[:side] = after[:side, :CLASSES]
        table[side:own] = after[:CLASSES, :side].T
        table[own] = -np.log(np.maximum(model.pairs.sum(axis=0)[:CLASSES], 1))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, score, count = None, np.zeros(CLASSES), 0  # of the word that the batch before ended in
        for b in batches:
            if not b.num_rows:
                continue
            hashes, told = b.column("hash").to_numpy(), b.column("told")
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))  # they come in order
            size = np.asarray(pc.binary_length(told)).astype(np.int64)
            what = laid_out(told)[0]
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
            # how often a word is told each thing, then one product with the table
            cell = np.bincount(np.repeat(word, size) * np.int64(own + 1) + what, minlength=len(first) * (own + 1)).reshape(-1, own + 1)
            scores, counts, here = cell @ table, cell[:, own], hashes[first]
            if name is not None and name == here[0]:
                scores[0] += score
                counts[0] += count
            elif name is not None:
                yield _chosen(np.array([name]), score[None], np.array([count]))
            name, score, count = here[-1], scores[-1], int(counts[-1])
            yield _chosen(here[:-1], scores[:-1], counts[:-1])
        if name is not None:
            yield _chosen(np.array([name]), score[None], np.array([count]))

    told = coded.where("not held_out").select("codes", "tail").mapInArrow(seen, "hash long, told binary")
    return told.repartition("hash").sortWithinPartitions("hash").mapInArrow(chosen, "hash long, cls int")


def _chosen(hashes: np.ndarray, scores: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    cls = np.where(counts > 1, scores.argmax(axis=1) if len(scores) else 0, ONCE).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(cls[: len(hashes)])], ["hash", "cls"])


def exchanged(head_class: np.ndarray, pairs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One round of exchange: each word of `own` in turn moves to the class that gives class bigrams the highest likelihood."""

    def phi(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    out, m = head_class.copy(), pairs.astype(float)
    cells, each = phi(m), np.arange(CLASSES)
    rows, cols = m.sum(axis=1), m.sum(axis=0)
    for w in range(1, len(own)):
        after, before, self_pairs = own[w, :ALL].astype(float), own[w, ALL:-1].astype(float), float(own[w, -1])
        a, n_row, n_col = out[w], after.sum(), before.sum()
        if not n_col:
            continue
        after[a], before[a] = max(0.0, after[a] - self_pairs), max(0.0, before[a] - self_pairs)

        def shift(c: int, sign: float, after: np.ndarray = after, before: np.ndarray = before, self_pairs: float = self_pairs, n_row: float = n_row, n_col: float = n_col) -> None:
            m[c] = np.maximum(m[c] + sign * after, 0)
            m[:, c] = np.maximum(m[:, c] + sign * before, 0)
            m[c, c] = max(0.0, m[c, c] + sign * self_pairs)
            rows[c] += sign * n_row
            cols[c] += sign * n_col
            cells[c], cells[:, c] = phi(m[c]), phi(m[:, c])

        shift(a, -1)
        x, y = np.flatnonzero(after), np.flatnonzero(before)
        gain = (phi(m[:CLASSES, x] + after[x]) - cells[:CLASSES, x]).sum(axis=1) + (phi(m[y, :CLASSES] + before[y, None]) - cells[y, :CLASSES]).sum(axis=0)
        mid, ra, lb = m[each, each], after[:CLASSES], before[:CLASSES]
        gain += phi(mid + ra + lb + self_pairs) - phi(mid + ra) - phi(mid + lb) + phi(mid)
        gain -= phi(np.maximum(rows[:CLASSES], 0) + n_row) - phi(np.maximum(rows[:CLASSES], 0)) + phi(np.maximum(cols[:CLASSES], 0) + n_col) - phi(np.maximum(cols[:CLASSES], 0))
        best = int(np.argmax(gain))
        out[w] = best if gain[best] > gain[a] + 1e-9 else a
        shift(out[w], 1)
    return out


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """The model of the training part, and all texts as codes."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch(docs.sparkSession) as folder:  # what is only needed until the texts are resolved
        return _fitted(docs, rounds, folder)


def _lexicon(counts: DataFrame, coded: DataFrame, names: list[bytes], model: ClassModel, moved: int, folder: str) -> DataFrame:
    """word, n, cls of all training words, written."""
    classes = assigned_words(coded, names, model, moved)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(_word_hashes(b.column("word")), pa.int64())], ["word", "n", "hash"])

    words = counts.mapInArrow(hashed, "word string, n long, hash long")
    return materialise(words.join(classes, "hash", "left").select("word", "n", F.coalesce("cls", F.lit(ONCE)).alias("cls")), "lexicon", folder)


def _fitted(docs: DataFrame, rounds: int, folder: str) -> tuple[ClassModel, DataFrame]:
    counts = materialise(word_counts(docs.where(~held_out())), "word-counts", folder)
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = sum(r[0] for r in counts.where(F.col("word") == END).select("n").collect())

    def frequent(words: DataFrame) -> DataFrame:
        return words.where((F.col("word") != END) & (F.octet_length("word") <= HEAD_BYTES)).orderBy(F.desc("n"), "word").limit(HEAD)

    top = frequent(counts).collect()
    names = [b"", *(r[0].encode() for r in top)]
    coded = _encoded(docs, {x: k for k, x in enumerate(names) if k}, folder)
    moved = min(len(names), CLUSTER_WORDS + 1)
    cls = np.full(len(names), ONCE)
    cls[1:moved], cls[0] = np.arange(moved - 1) % CLASSES, END_CLASS
    model = ClassModel(np.array([ends, *(r[1] for r in top)], np.int64), cls, np.zeros((ALL, ALL), np.int64), int(tokens), int(types))
    for _ in range(rounds):
        pairs, own = _gathered(coded, model, moved)
        model = replace(model, head_class=exchanged(model.head_class, pairs, own), pairs=pairs)
    model = replace(model, pairs=_gathered(coded, model, 0)[0])
    lexicon = _lexicon(counts, coded, names, model, moved, folder)
    others = [r["cls"] for r in frequent(lexicon).select("cls").collect()][moved - 1 :]
    model = replace(model, head_class=np.concatenate([model.head_class[:moved], np.array(others, np.int64)]))
    resolved = _resolved(coded, lexicon, folder)
    return replace(model, pairs=_gathered(resolved, model, 0)[0]), resolved


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scored(coded: DataFrame, model: ClassModel, weight: float = WEIGHT) -> DataFrame:
    """The columns of SCORES for each text of coded."""
    tokens, types, n_class = model.tokens, model.types, model.pairs.astype(float).sum(axis=0)
    after = _transitions(model.pairs.astype(float))
    weight = weight if n_class.sum() else 0.0
    per_class = np.divide(1.0, n_class, out=np.zeros(ALL), where=n_class > 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            _, size, n, cls = _classes(b, model)
            base = (n[1:] + ADD) / (tokens + ADD * (types + 1))
            p = weight * after[cls[:-1], cls[1:]] * n[1:] * per_class[cls[1:]] + (1 - weight) * base
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            total, plain, known = (np.add.reduceat(x, starts) if len(size) else x[:0] for x in (np.log10(p), np.log10(base), (n[1:] > 0).astype(np.int64)))
            out = [b.column("doc_id"), b.column("held_out"), size, known, np.full(len(size), tokens), plain, total, 10 ** (-total / size)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], [x.split()[0] for x in SCORES.split(", ")])

    return coded.mapInArrow(rows, SCORES)


def score(docs: DataFrame) -> DataFrame:
    model, coded = fit(docs)
    return scored(coded, model)
