"""Best-fit packing into fixed sequences, with large items matched first.

Documents become token ids and one end id; longer ones than a sequence are cut into whole sequences, the first piece taking
what is left over. What matters for packing is only how many pieces there are of each length, a table of at most `capacity`
rows: the packing is worked out on it, for runs of equal bins at a time, and pieces find their place by their rank among the
pieces of their length. So the plan's size depends on the capacity and not on the corpus.

Pieces above a third of the capacity meet at most twice in a bin: greedily, the longest with the longest that still fits.
The others fill the gaps best-fit, longest first, and open new bins where no gap takes them.

Defined results: null text counts as empty and gives the end id alone; repeated rows are packed each; null ids pass through;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textbatch import FEW, chunks, laid_out, ragged, span_hashes

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Fixed value: how such tokenizers split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length are ranked in so many parts, each by a task of its own.
PARTS = 64
#: A task remembers so many words with their ids, one in each slot, of at most LONGEST ids.
SLOTS, LONGEST = 1 << 18, 8
#: White space after which a space is no word's: of one, two and three bytes.
_SPACE1 = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_SPACE2, _SPACE3 = (np.array([int.from_bytes(chr(k).encode()) for k in (133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288) if len(chr(k).encode()) == n]) for n in (2, 3))


class TextEncoder:
    """Encodes texts as the tokenizers library does with a byte-level BPE file, each different word of a chunk once.

    The pattern never lets a token run over the border before a space that a non-space character follows, so a text is the
    sum of its head (up to its first space) and its words, each with the space before it. New words are encoded end to end and
    their ids cut where a word's bytes end; words are known by 64 bits of hash and their length. A text with a space before
    white space or at its end is encoded whole. The merging itself is tiktoken's, on the vocabulary of the same file; the
    tests hold its ids against the library's. A text that holds one of the file's added tokens is encoded by the library
    itself, as only that knows them.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the file spells bytes as characters: printable ones stand for themselves, the others for 256 and up in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {x["content"] for x in spec["added_tokens"]}
        self.path, self.added, self.library = path, [x.encode() for x in sorted(special)], None
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.key, self.bytes_of, self.n_ids = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.ids = np.zeros((SLOTS, LONGEST), np.uint32)

    def whole(self, text: bytes) -> np.ndarray:
        if any(x in text for x in self.added):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.array(self.plain(text.decode()), np.uint32)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, then where those of each word begin, and how many there are."""
        h, first, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        slot, size = (h >> np.uint64(40)).astype(np.int64) % SLOTS, (ends - starts)[first]
        there = (self.key[slot] == h) & (self.bytes_of[slot] == size)
        old = self.n_ids[slot[there]]
        pool = self.ids[slot[there]][np.arange(LONGEST) < old[:, None]]
        new = np.flatnonzero(~there)
        ids = np.array(self.plain(data[ragged(starts[first[new]], size[new])].tobytes().decode()) if len(new) else [], np.uint32)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size[new]), "right")
        own = np.diff(cuts, prepend=0)
        n, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        n[there], n[new] = old, own
        begin[there], begin[new] = np.cumsum(old) - old, len(pool) + cuts - own
        _, place = np.unique(slot[new], return_index=True)  # one word a slot
        place = place[own[place] <= LONGEST]
        to = slot[new[place]]
        self.key[to], self.bytes_of[to], self.n_ids[to] = h[new[place]], size[new[place]], own[place]
        if len(place):
            self.ids[to] = ids[np.minimum((cuts - own)[place][:, None] + np.arange(LONGEST), len(ids) - 1)]
        return np.concatenate([pool, ids]), begin[at], n[at]

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, off = laid_out(column)
        every, padded = data.tobytes(), np.concatenate([data, np.full(3, 32, np.uint8)])
        space = np.flatnonzero(data == 32)
        text = np.searchsorted(off, space, "right") - 1
        b, c, d = (padded[space + k].astype(np.int64) for k in (1, 2, 3))
        odd = _SPACE1[b] | np.isin((b << 8) | c, _SPACE2) | np.isin((b << 16) | (c << 8) | d, _SPACE3) | (space + 1 == off[text + 1])
        irregular = np.zeros(len(off) - 1, bool)
        irregular[text[odd]] = True
        irregular[np.searchsorted(off, [m.start() for x in self.added for m in re.finditer(re.escape(x), every)], "right") - 1] = True
        live = ~irregular[text]
        starts, text = space[live], text[live]
        first, last = np.diff(text, prepend=-1) > 0, np.diff(text, append=len(off)) > 0
        ends = np.where(last, off[text + 1], np.append(starts[1:], 0)[: len(starts)])
        pool, begin, n = self.words(data, starts, ends)
        of_words = pool[ragged(begin, n)]
        edge = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(text, np.arange(len(off)))]
        head = off[1:].copy()
        head[text[first]] = starts[first]
        return [np.concatenate([self.whole(every[off[k] : head[k]]), of_words[edge[k] : edge[k + 1]]]) for k in range(len(off) - 1)]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a row for each piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(path)
        for batch in batches:
            for part in chunks(batch, most=FEW):
                rows: list[tuple] = []
                for doc_id, own in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    ids = own.astype("<u4").tobytes() + np.uint32(END_ID).tobytes()
                    total = len(ids) // 4
                    cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), *([np.frombuffer(ids[4 * a : 4 * b], "<u4").view(np.int32)] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """How to pack counts[s] pieces of each length s: rows (length, first rank, pieces, first sequence, offset)."""
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of gaps, in order
    bins = 0

    def place(s: int, n: int, first: int, offset: int) -> None:
        rows.append((s, int(used[s]), n, first, offset))
        used[s] += n
        left[s] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.setdefault(gap, []):
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for s in range(capacity, capacity // 3, -1):
        while left[s]:
            t = next((t for t in range(min(s, capacity - s), capacity // 3, -1) if left[t] > (t == s)), 0)
            n = int(left[s] if not t else left[s] // 2 if t == s else min(left[s], left[t]))
            place(s, n, bins, 0)
            if t:
                place(t, n, bins, s)
            leave(capacity - s - t, bins, n)
            bins += n
    for s in range(capacity // 3, 0, -1):
        while left[s]:
            k = bisect.bisect_left(sizes, s)
            if k < len(sizes):
                gap = sizes[k]
                first, room = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
                n = int(min(left[s], room))
                leave(gap, first + n, room - n)
                place(s, n, first, capacity - gap)
                leave(gap - s, first, n)
            else:
                each = int(min(left[s], capacity // s))
                n = int(left[s] // each)
                for j in range(each):
                    place(s, n, bins, j * s)
                leave(capacity - each * s, bins, n)
                bins += n
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of tokenised() with sequence_id and offset."""
    pieces = materialise(tokenised(docs, path, capacity, with_ids), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    counts = np.zeros((capacity + 1, PARTS), np.int64)
    for r in pieces.groupBy("length", "part").count().collect():  # at most capacity * PARTS rows
        counts[r[0], r[1]] = r[2]
    before = np.cumsum(counts, axis=1) - counts
    rows = plan(counts.sum(axis=1), capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0] << 44) + rows[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part = b.column("length").to_numpy(), b.column("part").to_numpy()
            rank = before[length, part] + b.column("rank").to_numpy() - 1
            own = rows[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            keep = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], [*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c != "part"]
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("part").schema)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, the token ids of its pieces end to end, of pack(with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
