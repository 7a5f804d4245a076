r"""Chat formatting by columnar byte assembly.

A slice of ordered turns is formatted at once: the lengths of all segments (header, text, footer of each turn) give cumulative
offsets, headers and texts are copied by scatter indices into one buffer allocated beforehand, and that buffer, cut at the
conversations, is the Arrow column of formatted texts. The spans of assistant texts are the loss mask.

The template marks the turns of three roles by control strings; any other role is spelled out between two more. Inside texts and
roles a control string gets a backslash after its first character, and one more if it has some there already, so `<s>` becomes
`<\s>` and `<\s>` becomes `<\\s>`: no text holds a control string, and taking one backslash away restores every text.

Defined results: null text or role counts as empty; turns are ordered by turn (null first), then role, then text; repeated rows
are turns like any others; rows without conv_id form one conversation; an empty text has a header, a footer and, from an
assistant, an empty span; an empty table gives no rows; a conversation that spans slices comes as several rows in order of
(part, seq); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import text_of
from .textbatch import laid_out, ragged
from .turns import folded, in_order, slices, starts_of

#: Header and footer of the turns of a role.
ROLES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
#: Header of any other role, around its name, and the footer.
OTHER = ("[ROLE]", "[/ROLE] ", " </s>\n")
#: What follows the first character of a control string, by that character.
AFTER = {"<": ("s>", "/s>", "<SYS>>", "</SYS>>"), "[": ("INST]", "/INST]", "ROLE]", "/ROLE]")}
#: The role whose texts are learned.
LEARNED = "assistant"

_MARKED = [(re.escape(c), "|".join(map(re.escape, rest))) for c, rest in AFTER.items()]
_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("n_turns", pa.int32()), ("text", pa.string()), ("loss", pa.list_(_SPAN))])
_DIGESTS = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_TURN = re.compile("|".join([*(f"{re.escape(h)}(?P<{r}>.*?){re.escape(f)}" for r, (h, f) in ROLES.items()), f"{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}"]), re.S)
_ESCAPED = re.compile("|".join(rf"(?<={c})\\(?=\\*(?:{rest}))" for c, rest in _MARKED))


def escaped(texts: pa.Array) -> pa.Array:
    """Texts without control strings."""
    for first, rest in _MARKED:
        if pc.any(pc.match_substring_regex(texts, rf"{first}\\*({rest})")).as_py():
            texts = pc.replace_substring_regex(texts, rf"{first}(\\*)({rest})", rf"{first}\\\1\2".replace("\\[", "["))
    return texts


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted text")
        kind = m.lastgroup
        out.append((unescaped(m["role"]), unescaped(m["other"])) if kind == "other" else (kind, unescaped(m[kind])))
        at = m.end()
    return out


def learned_of(text: str, loss: list[dict]) -> str:
    """What lies under the loss mask."""
    data = text.encode()
    return "".join(unescaped(data[s["start"] : s["start"] + s["length"]].decode()) for s in loss)


def _pieces(roles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Headers and footers of the different roles end to end, where they begin (and the last ends), and each row's role."""
    coded = roles.dictionary_encode()
    names = coded.dictionary
    safe = escaped(names).to_pylist()
    parts = [p.encode() for name, inner in zip(names.to_pylist(), safe, strict=True) for p in ROLES.get(name, (f"{OTHER[0]}{inner}{OTHER[1]}", OTHER[2]))]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), np.asarray(coded.indices)


def assembled(piece: pa.RecordBatch, part: int, seq: int) -> pa.RecordBatch:
    """A slice of ordered turns as one row a conversation."""
    roles = piece.column("role")
    table, edge, role = _pieces(roles)
    data, off = laid_out(escaped(piece.column("text")))
    head, foot = 2 * role, 2 * role + 1
    lengths = np.stack([edge[head + 1] - edge[head], np.diff(off), edge[foot + 1] - edge[foot]], axis=1)
    at = np.concatenate([[0], np.cumsum(lengths.ravel())])
    begin = at[:-1].reshape(-1, 3)
    buffer = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, (source, start) in enumerate(((table, edge[head]), (data, off[:-1]), (table, edge[foot]))):
        out[ragged(begin[:, k], lengths[:, k])] = source[ragged(start, lengths[:, k])]
    first = starts_of(piece)
    bounds = np.append(first, piece.num_rows)
    n = len(first)
    cut = at[::3][bounds]
    texts = pa.StringArray.from_buffers(n, pa.py_buffer(cut.astype(np.int32)), buffer)
    learned = np.flatnonzero(np.asarray(pc.equal(roles, LEARNED)))
    which = np.searchsorted(first, learned, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((begin[learned, 1] - cut[which]).astype(np.int32)), pa.array(lengths[learned, 1].astype(np.int32))], ["start", "length"])
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]).astype(np.int32)), spans, type=pa.list_(_SPAN))
    opened = np.zeros(n, bool)
    opened[[0, -1]] = True
    columns = [piece.column("conv_id").take(pa.array(first)), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(opened), pa.array(np.diff(bounds).astype(np.int32)), texts, loss]
    return pa.RecordBatch.from_arrays(columns, schema=_FORMATTED)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, seq, piece in slices(batches):
        yield assembled(piece, part, seq)


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, part, seq, open, n_turns, text, loss (bytes under the loss mask: start and length) of turns (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of().alias("text"))
    return in_order(rows).mapInArrow(_format, from_arrow_schema(_FORMATTED))


class ReadBack:
    """Digests of one conversation, read back from its formatted texts."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, row: dict) -> None:
        for role, text in turns_of(row["text"]):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        learned = learned_of(row["text"], row["loss"])
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(row["text"])

    def done(self) -> dict:
        return {"n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: one row a conversation. A SHA-256 runs over a
    conversation from end to end, so one that spans slices passes through one task, slice by slice."""
    return folded([(formatted.select(_FORMATTED.names), iter)], _FORMATTED, ReadBack, _DIGESTS)


#: Conversation -7 of the query: control strings in the texts of both sides.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

#: The same in DuckDB.
SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '[\\\1\2', 'g')) AS n,
    length(regexp_replace(regexp_replace(role, '<(\\*)(s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '[\\\1\2', 'g')) AS m
  FROM every
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE m + 20 END) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""
