r"""Conversation structure repair by cost layers.

A conversation's role initials must read `(s?(ua)+)?`: an optional system turn, then user and assistant turns in alternation. The
grammar has four states, so the states reachable at a turn are a bitset. Layer c holds, for each turn, the bitset of states from
which the rest can be accepted at cost c or less; it follows from the layers of cost c - 1 to c - 4 by table lookups, turn by turn
from the end. The first layer that holds the start state before the first turn gives the cost. Following bits through the layers
from there, always by the ASCII-least edit that keeps to the cost, gives the least audit. A state leaves only one role for a turn
that is inserted or gets a new role, so the audit settles the repaired turns.

Long conversations are laid out in segments of 32 turns: what a segment needs of those after it is the least cost from each of the
four states, so layers stay few and time is linear in the turns. One byte a turn is all that a conversation needs to be solved.

Edits: Keep 0, Rerole 2, Delete 3, Insert 2; a truncated turn that isn't deleted adds 1; blank and duplicate turns are deleted.

Defined results: a null role or text is one space; turns are ordered by turn (null first, which counts as -2^63), then role, then text; of turns with
equal role and text all but the first are duplicates; roles whose initial isn't s, u or a can't be kept; rows without conv_id form
one conversation; a conversation without rows costs nothing and has an empty audit; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import materialise
from .turns import folded, in_batches, in_order, slices, starts_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "sua"
#: The grammar: from the start, after s, after u, after a; the first and the last accept.
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: Where a user or assistant turn leads, and which of them it can be.
ADVANCE = (2, 2, 3, 2)
NEEDED = ("user", "user", "assistant", "user")
START, ACCEPTING, ALL = 0, 0b1001, 0b1111
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
FAULTS = ("none", "blank", "duplicate", "truncated")
SEGMENT = 32

#: By bitset: the states that a turn of the needed role, or a kept turn of each initial, takes into it.
_BACK = [sum(1 << q for q in range(4) if m >> ADVANCE[q] & 1) for m in range(16)]
_KEPT = [[sum(1 << q for q in range(4) if m >> STEP.get((q, s), 9) & 1) for m in range(16)] for s in range(4)]


def _remembered(f: Callable, most: int = 1 << 14) -> Callable:
    """f with a memory of so many results; most conversations are short and alike. Unlike functools.lru_cache it travels by value."""
    known: dict = {}

    def g(*args):
        if args not in known:
            if len(known) >= most:
                known.clear()
            known[args] = f(*args)
        return known[args]

    return g


def code_of(symbol: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """A byte a turn: its initial (3: none of the grammar's), and its fault."""
    return (symbol | fault << 2).astype(np.uint8)


def layers(codes: bytes, ends: tuple[int, ...], whole: bool) -> list[bytes]:
    """Bitsets by cost and turn, up to the layer that holds all states before the first turn, or the start if `whole`.

    ends: the least cost from each state after the last turn, the smallest of them zero.
    """
    n, out = len(codes), []
    none = bytes(n + 1)
    while True:
        c = len(out)
        one, two, three, two_more = (out[c - k] if c >= k else none for k in (1, INSERT, DELETE, REROLE + CUT))
        now = bytearray(n + 1)
        now[n] = sum(1 << q for q in range(4) if ends[q] <= c) | _BACK[two[n]]
        for i in range(n - 1, -1, -1):
            code = codes[i]
            fault = code >> 2
            reached = one[i] | _BACK[two[i]] | three[i + 1]
            if fault == 0:
                reached |= _KEPT[code & 3][now[i + 1]] | _BACK[two[i + 1]]
            elif fault == 3:
                reached |= _KEPT[code & 3][one[i + 1]] | _BACK[two_more[i + 1]]
            now[i] = reached
        out.append(bytes(now))
        if now[0] == ALL or whole and now[0] >> START & 1:
            return out


def _has(out: list[bytes], c: int, i: int, q: int) -> bool:
    return c >= 0 and out[min(c, len(out) - 1)][i] >> q & 1 == 1


@_remembered
def _least(codes: bytes, ends: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost from each state before a segment."""
    out = layers(codes, ends, False)
    return tuple(next(c for c, bits in enumerate(out) if bits[0] >> q & 1) for q in range(4))


@_remembered
def _traced(codes: bytes, ends: tuple[int, ...], q: int, last: bool, whole: bool) -> tuple[str, int]:
    """The least edits of a segment from state q on, and the state after it."""
    out, audit, i = layers(codes, ends, whole), [], 0
    c = next(c for c, bits in enumerate(out) if bits[0] >> q & 1)
    while i < len(codes) or (last and c > 0):
        code = codes[i] if i < len(codes) else None
        fault = 1 if code is None else code >> 2
        extra = CUT if fault == 3 else 0
        kept = STEP.get((q, code & 3)) if fault in (0, 3) else None
        if code is not None and _has(out, c - DELETE, i + 1, q):
            audit.append("D")
            c, i = c - DELETE, i + 1
        elif _has(out, c - INSERT, i, ADVANCE[q]):
            audit.append("I")
            c, q = c - INSERT, ADVANCE[q]
        elif kept is not None and _has(out, c - extra, i + 1, kept):
            audit.append("K")
            c, i, q = c - extra, i + 1, kept
        else:
            audit.append("R")
            c, i, q = c - extra - REROLE, i + 1, ADVANCE[q]
    return "".join(audit), q


def least_audit(codes: bytes) -> tuple[int, str]:
    """The cost and the least audit of a conversation."""
    cuts = range(0, max(1, len(codes)), SEGMENT)
    # cost beyond which an end without acceptance is never worth while: two inserts always get there
    last = tuple(0 if ACCEPTING >> q & 1 else 3 * INSERT for q in range(4))
    ends, base = [last], 0
    for k in reversed(cuts[1:]):
        there = _least(codes[k : k + SEGMENT], ends[-1])
        base += min(there)
        ends.append(tuple(x - min(there) for x in there))
    first = layers(codes[:SEGMENT], ends[-1], True)
    q, audit = START, []
    for k, then in zip(cuts, reversed(ends), strict=True):
        piece, q = _traced(codes[k : k + SEGMENT], then, q, k == cuts[-1], k == 0)
        audit.append(piece)
    return base + len(first) - 1, "".join(audit)


_PLACE = [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_())]
_COUNTS = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_LAID = pa.schema([*_PLACE, ("codes", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("days", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_REPAIRED = pa.schema([*_PLACE, *_COUNTS, ("turns", pa.list_(_TURN))])
_DIGESTS = pa.schema([*_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns as one row a conversation and slice: codes, the turns' numbers in short, roles and texts."""
    before = None
    for part, seq, piece in slices(batches):
        first = starts_of(piece)
        dropped = np.asarray(piece.column("dropped"))
        rows = piece.filter(pa.array(~dropped))
        bounds = np.concatenate([[0], np.cumsum(~dropped)])[np.append(first, piece.num_rows)]
        # a turn equal to the one before it in all columns
        same = np.ones(rows.num_rows, bool)
        for c in ("conv_id", "turn", "role", "text"):
            col = rows.column(c)
            here = pa.concat_arrays([pa.array([before[c] if before else None], col.type), col])
            same &= np.asarray(pc.or_(pc.fill_null(pc.equal(here[1:], here[:-1]), False), pc.and_(pc.is_null(here[1:]), pc.is_null(here[:-1]))))
        if rows.num_rows:
            if before is None:
                same[0] = False
            before = rows.slice(rows.num_rows - 1).to_pylist()[0]
        blank, earlier, cut = (np.asarray(rows.column(c), bool) for c in ("blank", "earlier", "cut"))
        fault = np.select([blank, earlier | same, cut], [1, 2, 3], 0)
        symbol = np.asarray(pc.index_in(pc.utf8_slice_codeunits(rows.column("role"), 0, 1), pa.array(list(SYMBOLS))).fill_null(3))
        codes = code_of(symbol, fault).tobytes()
        ids = piece.column("conv_id")

        def laid(k: int) -> dict:
            a, b = int(bounds[k]), int(bounds[k + 1])
            numbers = np.unique(np.asarray(rows.column("turn").slice(a, b - a).drop_null(), np.int64))
            low, high = (int(numbers[0]), int(numbers[-1])) if len(numbers) else (None, None)
            return {
                "conv_id": ids[int(first[k])].as_py(), "part": part, "seq": seq, "open": k in (0, len(first) - 1), "codes": codes[a:b], "low": low, "high": high, "days": len(numbers),
                "roles": rows.column("role").slice(a, b - a).to_pylist(), "texts": rows.column("text").slice(a, b - a).to_pylist(),
            }

        yield from in_batches((laid(k) for k in range(len(first))), _LAID)


class Solved:
    """What a conversation's codes and turn numbers settle; add() them in order, then repaired() its rows in order."""

    def __init__(self) -> None:
        self.codes, self.low, self.high, self.days = bytearray(), None, None, 0

    def add(self, row: dict) -> None:
        self.codes += row["codes"]
        if row["low"] is not None:
            self.days += row["days"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]

    def solve(self) -> None:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        faults, symbol = np.bincount(codes >> 2, minlength=4), codes & 3
        pair = symbol[:-1] * 4 + symbol[1:]
        legal = [SYMBOLS.index(a) * 4 + SYMBOLS.index(b) for a, b in ("su", "ua", "au")]
        self.cost, self.audit = least_audit(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.days
        self.counts = {"cost": self.cost, "gaps": gaps, "blank": int(faults[1]), "duplicate": int(faults[2]), "truncated": int(faults[3]), "illegal": int((~np.isin(pair, legal)).sum())}
        self.state, self.at, self.left = START, 0, len(codes)

    def repaired(self, row: dict) -> dict:
        turns, k = [], 0
        n = len(row["codes"])
        self.left -= n
        while self.at < len(self.audit) and (k < n or not self.left):
            edit = self.audit[self.at]
            self.at += 1
            if edit == "I":
                turns.append({"edit": edit, "role": NEEDED[self.state], "text": ""})
                self.state = ADVANCE[self.state]
                continue
            role, text = row["roles"][k], row["texts"][k]
            if edit == "R":
                role, self.state = NEEDED[self.state], ADVANCE[self.state]
            elif edit == "K":
                self.state = STEP[self.state, SYMBOLS.index(role[0])]
            turns.append({"edit": edit, "role": role, "text": text})
            k += 1
        return {c: row[c] for c in ("conv_id", "part", "seq", "open")} | self.counts | {"turns": turns}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                one = Solved()
                one.add(row)
                one.solve()
                yield one.repaired(row)

    yield from in_batches(each(), _REPAIRED)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 have a conversation's codes, in order; those of kind 1, which follow, its texts."""

    def each() -> Iterator[dict]:
        at, one = object(), None
        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 16) for r in batch.slice(k, 16).to_pylist()):
                if row["kind"] == 0:
                    if one is None or row["conv_id"] != at or hasattr(one, "cost"):
                        at, one = row["conv_id"], Solved()
                    one.add(row)
                else:
                    if not hasattr(one, "cost"):
                        one.solve()
                    yield one.repaired(row)

    yield from in_batches(each(), _REPAIRED)


def _sources(turns: DataFrame) -> list[tuple[DataFrame, Callable]]:
    """Laid out turns, and what solves them: of conversations that lie in one slice, and of the others, codes before texts."""
    space = F.lit(" ")
    gone = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.when(gone, F.lit("")).otherwise(F.col(c)), space).alias(c) for c in ("role", "text")], gone.alias("dropped"))
    number = F.coalesce("turn", F.lit(-(1 << 63)))
    print_ = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    copies = rows.where("not dropped").groupBy("conv_id", F.xxhash64("role").alias("r"), *print_).agg(F.min(number).alias("first"), F.max(number).alias("last"))
    copies = copies.where("first < last").select(F.col("conv_id").alias("c"), "r", "h1", "h2", "first")
    own = rows.select("*", *print_)
    met = own["conv_id"].eqNullSafe(copies["c"]) & (F.xxhash64(own["role"]) == copies["r"]) & (own["h1"] == copies["h1"]) & (own["h2"] == copies["h2"])
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = own.join(copies, met, "left").select(
        own["conv_id"], "turn", "role", "text", "dropped", (tail == "").alias("blank"), F.coalesce(number > F.col("first"), F.lit(False)).alias("earlier"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    laid = materialise(in_order(marked).mapInArrow(_laid_out, from_arrow_schema(_LAID)), "turns")
    opened = laid.where("open")
    codes = opened.select(F.lit(0).alias("kind"), "conv_id", "part", "seq", "open", "codes", "low", "high", "days", *[F.lit(None).cast("array<string>").alias(c) for c in ("roles", "texts")])
    both = codes.unionByName(opened.withColumn("kind", F.lit(1)))
    return [(laid.where("not open"), _whole), (both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq"), _opened)]


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, part, seq, open, cost, the counts of faults and turns (edit, role, text; deleted ones too) of turns (conv_id, turn,
    role, text, and optionally dropped: rows that only name their conversation). A conversation over several slices has several
    rows in order of (part, seq), each with its own turns and the same counts."""
    whole, opened = (df.mapInArrow(f, from_arrow_schema(_REPAIRED)) for df, f in _sources(turns))
    return whole.unionByName(opened)


class Digest:
    """Counts, audit and digest of one repaired conversation."""

    def __init__(self) -> None:
        self.sha, self.audit, self.started, self.counts = hashlib.sha256(), [], False, {}

    def add(self, row: dict) -> None:
        self.counts = {c: row[c] for c, _ in _COUNTS}
        self.audit.append("".join(t["edit"] for t in row["turns"]))
        for t in row["turns"]:
            if t["edit"] != "D":
                self.sha.update(f"{chr(10) if self.started else ''}{t['role']}:{t['text']}".encode())
                self.started = True

    def done(self) -> dict:
        return self.counts | {"audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of what repair() makes of turns: one row a conversation."""
    return folded(_sources(turns), _REPAIRED, Digest, _DIGESTS)


def damaged(turns: DataFrame) -> DataFrame:
    """turns with planted faults, by the remainder of crc32(conv_id:turn) by 20: 0 drops a row (it only names its conversation
    from then on), 1 empties the text, 2 takes its . ! and ? away, 3 repeats the row, 4 makes its role user. Nulls are one space."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(role).alias("role"), F.when(k == 1, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (k == 0).alias("dropped"), k.alias("k"))
    return rows.select("*", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("k", "copy")
