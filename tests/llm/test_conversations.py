"""Chat formatting and structure repair against plain versions, on tables with nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import chat, repair, turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, h1 int"
SF = "/root/testdata/sf0.001"


def made():
    rng = np.random.default_rng(3)
    rows = [(1, 0, "user", "Hello <s> there."), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "")]
    rows += [(2, None, "assistant", "No turn!"), (2, None, None, "Neither."), (2, 5, "tool]\n[/ROLE]", "x [ROLE] <\\s> <\\\\s> \\"), (2, 5, "user", "tie."), (2, 5, "user", "tie."), (2, 9, "", "é \n")]
    rows += [(None, 0, "user", "Whose?"), (None, 1, "assistant", "Nobody's."), (None, None, None, None)]
    rows += [(3, k, "user" if k % 2 == 0 else "assistant", f"{'long words here. ' * int(rng.integers(1, 40))}{k % 7}{'.' if k % 3 else ''}") for k in range(400)]
    rows += [(4, 0, "system", "Be brief."), (4, 2, "system", "Be brief."), (4, 3, "assistant", "a" * 70_000 + "?"), (5, 0, "assistant", "Only.")]
    words = ["yes.", "no", "", " \t", "why?", "ok!"]
    for c in range(10, 70):
        rows += [(c, int(t), ("user", "assistant", "system", "u2", "x")[rng.choice(5, p=[0.4, 0.35, 0.1, 0.1, 0.05])], words[rng.integers(len(words))]) for t in np.sort(rng.integers(0, 9, rng.integers(1, 9)))]
    return rows


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    rows = made()
    path = str(tmp_path_factory.mktemp("chat") / "conversations.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(rows):
    out = {}
    for c, own in groups(rows).items():
        own = by_turn(own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(learned), sha(learned))
    return out


def groups(rows):
    found = collections.defaultdict(list)
    for r in rows:
        found[r[0]].append(r)
    return found


@pytest.mark.parametrize("size", [2 << 20, 300])
def test_chat_is_read_back(conversations, monkeypatch, size):
    monkeypatch.setattr(turns, "SLICE", size)  # small slices: conversations over many rows and tasks
    rows, df = conversations
    got = chat.read_back(chat.format_chat(df)).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == plain_digests(rows) and len(got) == len(groups(rows))


def test_chat_texts_and_mask(conversations):
    rows, df = conversations
    formatted = chat.format_chat(df).where("conv_id = 1").collect()
    whole = "".join(r["text"] for r in sorted(formatted, key=lambda r: (r["part"], r["seq"])))
    want = "[INST] Hello <\\s> there. [/INST]\n<s> <\\/s>[\\INST] ok [\\/INST] </s>\n[INST]  [/INST]\n<s>  </s>\n"
    assert whole == want
    assert next(r["formatted_chars"] for r in chat.read_back(chat.format_chat(df)).collect() if r["conv_id"] == 1) == len(want)
    spans = [r["text"].encode()[s["start"] : s["start"] + s["length"]].decode() for r in formatted for s in r["loss"]]
    assert spans == ["<\\/s>[\\INST] ok [\\/INST]", ""]


def test_escapes_are_reversible():
    bits = ["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "a"]
    texts = ["".join(c) for n in range(5) for c in itertools.product(bits, repeat=n)]
    safe = chat.escaped(pa.array(texts)).to_pylist()
    marks = [first + rest for first, after in chat.AFTER.items() for rest in after]
    for text, out in zip(texts, safe, strict=True):
        assert chat.unescaped(out) == text and not any(m in out for m in marks)
    for text in texts[:: len(texts) // 500]:
        piece = pa.RecordBatch.from_pydict({"conv_id": [1, 1, 1, 1], "role": ["user", "assistant", "system", text], "text": [text] * 4})
        one = chat.assembled(piece, 0, 0).to_pylist()[0]
        assert [t for _, t in chat.turns_of(one["text"])] == [text] * 4
        assert chat.learned_of(one["text"], one["loss"]) == text * (1 + (text == "assistant"))


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(ch for ch in text if ch not in ".!?") if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(own):
    """All cheapest edits by (cost, audit), state by state."""
    own = by_turn(own)
    seen, faults = set(), []
    for _, _, role, text in own:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, said) in list(states.items()):
                for role in ("user", "assistant"):
                    to = step.get((q, role[0]))
                    if to and (new := (cost + 2, audit + "I", [*said, f"{role}:"])) < states.get(to, (1 << 60,)):
                        states[to] = new
        return states

    states = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(own, faults, strict=True):
        after = {}

        def put(q, new, after=after):
            if q is not None and new < after.get(q, (1 << 60,)):
                after[q] = new

        for q, (cost, audit, said) in states.items():
            put(q, (cost + 3, audit + "D", said))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                put(step.get((q, role[:1])), (cost + extra, audit + "K", [*said, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    put(step.get((q, new[0])), (cost + extra + 2, audit + "R", [*said, f"{new}:{text}"]))
        states = inserted(after)
    cost, audit, said = min(states[q] for q in ("", "a") if q in states)
    numbers = [r[1] for r in own if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[2][:1] or " ") + (b[2][:1] or " ") not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)))


def expected(rows, damage):
    own = groups(plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    return {c: plain_repair(own[c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize(("size", "damage"), [(2 << 20, True), (300, True), (300, False)])
def test_repair_is_cheapest_and_least(conversations, monkeypatch, size, damage):
    monkeypatch.setattr(turns, "SLICE", size)
    rows, df = conversations
    got = repair.digests(repair.damaged(df) if damage else df).collect()
    want = expected(rows, damage)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_repaired_turns(conversations, monkeypatch):
    monkeypatch.setattr(turns, "SLICE", 300)
    rows, df = conversations
    said = collections.defaultdict(list)
    for r in sorted(repair.repair(df).collect(), key=lambda r: (r["part"], r["seq"])):
        said[r["conv_id"]] += [(t["edit"], t["role"], t["text"]) for t in r["turns"]]
    for c, want in expected(rows, False).items():
        assert "".join(e for e, _, _ in said[c]) == want[6] and sha("\n".join(f"{r}:{x}" for e, r, x in said[c] if e != "D")) == want[7]


def test_query_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    from tapeworks.llm import queries

    assert {r[0]: tuple(r)[1:] for r in queries.op12_structure_repair(spark, SF).collect()} == expected(rows, True)
    assert {r[0]: tuple(r)[1:5] for r in queries.op11_chat_format(spark, SF).collect()} == plain_digests(rows + chat.PLANTED)


def test_audit_of_random_codes():
    rng = np.random.default_rng(8)
    for n in [*range(1, 9)] * 12 + [31, 32, 33, 64, 65, 200]:
        roles = [("system", "user", "assistant", "x")[k] for k in rng.choice(4, n, p=[0.1, 0.45, 0.35, 0.1])]
        texts = [("." if f == 0 else "" if f == 1 else "t") for f in rng.choice(3, n, p=[0.6, 0.15, 0.25])]
        own = [(1, k, role, f"{k}{t}" if t else "") for k, (role, t) in enumerate(zip(roles, texts, strict=True))]
        symbol = np.array(["sua".find(r[0]) % 4 for r in roles])
        fault = np.array([0 if t == "." else 1 if not t else 3 for t in texts])
        assert repair.least_audit(repair.code_of(symbol, fault).tobytes()) == plain_repair(own)[5:7]


def test_empty_tables(empty):
    assert chat.read_back(chat.format_chat(empty)).collect() == []
    assert repair.digests(repair.damaged(empty)).collect() == []


def test_one_conversation_spreads_over_tasks(spark):
    """All rows in one conversation: ranges deal it to several tasks, and only pieces are sent on."""
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}." * 20) for k in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_chat(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small otherwise
    try:
        assert formatted.select("part").distinct().count() > 1
        got = chat.read_back(formatted).first()
        one = repair.digests(df).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["n_turns"] == 6000 and got["turns_sha256"] == plain_digests(rows)[7][1]
    assert one["cost"] == 0 and one["audit"] == "K" * 6000
