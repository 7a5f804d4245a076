"""Each operator against a plain version on a small table with nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks.llm import brown, exact, graph, licenses, lines, mixing, packing, quality, simhash, toxicity, warc
from tapeworks.llm.common import materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made(n_words, seed, vocabulary=300):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.zipf(1.3, n_words) % vocabulary)


@pytest.fixture(scope="module")
def table(spark):
    """Rows as tuples, and the same as a table of files."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one", None), (5, "Äpfel ÉTÉ Straße été", "b")]
    body = "\n".join(made(30, k) for k in range(4))
    rows += [(10, body, "a"), (11, body, "a"), (11, body, "a"), (12, body.replace("w3 ", "w4 ", 1), "c"), (None, body, "c"), (None, made(40, 77), "c")]
    rows += [(20 + k, "\n".join(made(12 + j, 100 + 7 * k + j) for j in range(3)), "abc"[k % 3]) for k in range(30)]
    rows += [(90, made(6000, 9), "c"), (91, "This work is licensed under the GNU General Public License, version 3.\n" + made(20, 5), "a")]
    return rows, spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    table[1].repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_lm_base_score_and_gain(docs, table):
    got = brown.score(docs).collect()
    rows = table[0]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*words(lower(t)), "\n"]
    count = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i if i is not None else -1, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_lm_tail_words_and_mass(docs, monkeypatch):
    whole = {(r[0], r[2]): r for r in brown.score(docs).collect()}
    monkeypatch.setattr(brown, "HEAD", 20)
    for r in brown.score(docs).collect():
        assert r["n_known"] == whole[r[0], r[2]]["n_known"] and abs(r["base_score"] - whole[r[0], r[2]]["base_score"]) < 1e-6
    model, _ = brown.fit(docs)
    pairs = model.pairs.astype(float)
    share = pairs.sum(axis=0) / pairs.sum()
    after = (pairs + share) / (pairs.sum(axis=1, keepdims=True) + 1)
    assert np.allclose(after.sum(axis=1), 1)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    n = 41
    text = [1 + 20 * (k % 2) + rng.integers(0, 20) for k in range(4000)]  # two classes that alternate
    cls = np.full(n, brown.END_CLASS)
    cls[1:] = np.arange(n - 1) % brown.CLASSES

    def gathered(c):
        pairs, own = np.zeros((brown.ALL, brown.ALL), np.int64), np.zeros((n, 2 * brown.ALL + 1), np.int64)
        for a, b in zip(text, text[1:], strict=False):
            pairs[c[a], c[b]] += 1
            own[a, c[b]] += 1
            own[b, brown.ALL + c[a]] += 1
            own[a, -1] += a == b
        return pairs, own

    def likelihood(p):
        phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return phi(p.astype(float)) - phi(p.sum(axis=0).astype(float)) - phi(p.sum(axis=1).astype(float))

    cls[1:] = rng.integers(0, 2, n - 1)
    start = likelihood(gathered(cls)[0])
    for _ in range(3):
        pairs, own = gathered(cls)
        cls = brown.exchanged(cls, pairs, own)
    assert likelihood(gathered(cls)[0]) > start


def plain_lines(rows):
    """Lines to remove by doc: all pairs, in order."""
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] if r[1][0] is not None else 1 << 42, r[0]))
    seen, out = [], collections.defaultdict(set)
    for doc, (_, (i, t, _)) in ((r[1][0], r) for r in order):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            if any((d, j) != (i, k) and (old == line or len(s & o) >= 0.8 * len(s | o) - 1e-9) for d, j, old, o in seen):
                out[doc].add(k)
            seen.append((i, k, line, s))
    return out


def test_line_dedup_against_all_pairs(docs, table):
    want = plain_lines(table[0])
    got = lines.duplicate_lines(docs).collect()
    assert len(got) == len(table[0])
    for r in got:
        if r["doc_id"] is not None:
            assert set(r["removed_lines"]) == want[r["doc_id"]], r["doc_id"]
            assert r["n_removed"] == len(r["removed_lines"])
    kept = lines.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert 12 not in {r["doc_id"] for r in kept.collect()}  # all its lines were there before


def test_line_dedup_tries_are_only_a_shortcut(docs, monkeypatch):
    whole = sorted((str(r[0]), r[2], tuple(r[3])) for r in lines.duplicate_lines(docs).collect())
    monkeypatch.setattr(lines, "LAST", 0)
    assert whole == sorted((str(r[0]), r[2], tuple(r[3])) for r in lines.duplicate_lines(docs).collect())


def test_line_dedup_short_lines(spark):
    texts = ["Les.", "Les.\nLes.  Les.", "a b c", "c  a b a\na b d", "p q r s t", "q p s r\np q r u", "p q x", "\n \n", "\n \nv w"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["removed_lines"] for r in lines.duplicate_lines(frame).collect()}
    assert got == {0: [], 1: [0, 1], 2: [], 3: [0], 4: [], 5: [0], 6: [], 7: [], 8: []}


def test_line_dedup_rows_without_own_id(spark, tmp_path):
    """Every row is compared for itself: in order of doc_id, then of its place in the file."""
    line = [made(12, 500 + k) for k in range(5)]
    rows = [(7, line[0]), (None, line[0]), (None, line[1] + "\n" + line[2]), (None, line[3] + "\n" + line[2]), (9, line[4]), (9, "\n" + line[4]), (9, line[3] + " x y z"), (1 << 50, line[4])]
    rows += [(11, "\n" * (1 << 20) + line[1])]
    want = [[], [0], [0], [1], [], [1], [], [0], []]
    want = sorted((str(i), tuple(w)) for (i, _), w in zip(rows, want, strict=True))
    path = str(tmp_path / "rows.parquet")
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    frame.write.parquet(path)
    assert sorted((str(r[0]), tuple(r[3])) for r in lines.duplicate_lines(spark.read.parquet(path)).collect()) == want
    kept = [r["text"] for r in lines.without_duplicates(frame).collect() if r["doc_id"] is None]  # no scan of files
    assert sorted(kept) == sorted([line[2], line[3]])


def plain_fingerprint(text):
    w = words(lower(text))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_against_all_pairs(docs, table):
    rows = table[0]
    prints = np.array([plain_fingerprint(t) for _, t, _ in rows], np.uint64)
    label = plain_components(prints)
    least = {c: min((rows[k][0] for k in np.flatnonzero(label == c) if rows[k][0] is not None), default=None) for c in set(label.tolist())}
    want = sorted((str(rows[k][0]), f"{int(prints[k]):016x}", least[label[k]]) for k in range(len(rows)))
    assert sorted((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.tolist()))


@pytest.mark.parametrize(("leaf", "shard"), [(1024, 20_000), (16, 60)])
def test_vantage_trees_lose_no_link(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(0)
    points = [rng.integers(0, 2**63, 150, dtype=np.uint64)]
    for b in points[0][:30]:
        v = np.full(20, b)
        for _ in range(5):
            v = v ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64))
        points.append(v)
    hot = np.full(300, points[0][0])
    for _ in range(12):
        hot = hot ^ (np.uint64(1) << rng.integers(0, 20, 300, dtype=np.uint64))
    prints = np.unique(np.concatenate([*points, hot]))
    frame = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    got = {r[0]: r[1] for r in graph.components(simhash.similar_links(frame, shard=shard)).collect()}
    mine = [got.get(int(v), int(v)) for v in prints.view(np.int64)]
    pairs = set(zip(mine, plain_components(prints).tolist(), strict=True))
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (7, None)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(51)} == {0} and {got[1000 + k] for k in range(60)} == {1000}


def test_exact_dedup(docs, table):
    rows = table[0]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = exact.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"] and hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.exact_duplicates(docs.orderBy("doc_id")).where("kept").count() == len(groups)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << exact.BITS, n, dtype=np.uint64))
        k, unary, rest = exact.golomb(v)
        assert (exact.ungolomb(len(v), k, unary, rest) == v).all()


def test_exact_dedup_blocks(docs, monkeypatch):
    want = sorted(map(str, exact.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact, "BLOCK", 64)
    assert sorted(map(str, exact.exact_duplicates(docs).collect())) == want


def test_mixing(docs, table):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    rows = table[0]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, target = sum(size.values()), set(names), {}
    while True:
        level = (total - sum(target.values())) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    by_source = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        s = next(s for i, t, s in rows if i == r["doc_id"] and len(words(t)) == r["size"])
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        by_source[s] += r["taken"]
    largest = max(len(words(t)) for _, t, _ in rows)
    assert all(abs(by_source[s] - target[s]) <= largest for s in names)
    assert mixing.take(docs).count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_licenses_against_every_window(spark, docs, table):
    def runs(text):
        w = words(re.sub(r"""[.,;:()"']""", "", (text or "").lower()))
        return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]

    want = set()
    for i, t, _ in table[0]:
        for name, template in licenses.TEMPLATES + licenses.TEXTS:
            own, m = set(runs(template)), len(runs(template))
            r = runs(t)
            if any(len(set(r[a : a + 2 * m]) & own) >= 0.8 * len(own) for a in range(0, max(1, len(r)), m)):
                want.add((i, name))
    got = licenses.scan_licenses(docs, licenses.template_table(spark))
    assert {(r["doc_id"], r["license"]) for r in got.collect()} == want == {(91, "GPL-3.0")}


def test_license_texts_altered_and_in_part(spark):
    rng = np.random.default_rng(4)
    filler, texts, want = made(3000, 8).split(), [], set()
    for k, (name, template) in enumerate(licenses.TEXTS):
        w = template.split()
        n = len(w) - 4
        few = [x if i not in (len(w) // 3, 2 * len(w) // 3) else "other" for i, x in enumerate(w)]
        parts = {"whole": w, "few": few, "most": w[: 4 + math.ceil(0.81 * n)], "half": w[: len(w) // 2], "many": [x if i % 4 else "other" for i, x in enumerate(w)]}
        for kind, own in parts.items():
            cut = int(rng.integers(0, 2900))
            own = [*filler[:cut], *own, *filler[cut:]] if k % 2 else own
            every = {tuple(w[i : i + 5]) for i in range(n)}
            if len(every & {tuple(own[i : i + 5]) for i in range(len(own) - 4)}) >= 0.8 * len(every):
                want.add((len(texts), name))
            assert kind == "few" or ((len(texts), name) in want) == (kind in ("whole", "most")), (name, kind)
            texts.append(" ".join(own).upper() if k == 2 else "\n".join(own))
    texts += [texts[0], texts[0] + " " + made(150_000, 3) + " " + texts[0]]
    want |= {(len(texts) - 2, licenses.TEXTS[0][0]), (len(texts) - 1, licenses.TEXTS[0][0])}
    own = spark.createDataFrame(licenses.TEXTS, "license string, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(frame, own).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(got) == len(want)


def test_short_license_templates(spark):
    own = spark.createDataFrame([("two", "Keep out"), ("three", "All rights reserved."), ("six", "one two three four five six")], "license string, text string")
    texts = ["x y\nAll rights\nreserved", "all rights", "keep (out) all Rights reserved. one two three four five six", "rights reserved all keep in", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan_licenses(frame, own).collect()}
    assert got == {(0, "three", 2), (2, "two", 0), (2, "three", 2), (2, "six", 5)}
    assert {r["license"] for r in licenses.scan_licenses(frame, licenses.template_table(spark)).collect()} == {"All-rights-reserved"}
    with pytest.raises(ValueError, match="without a word"):
        licenses.scan_licenses(frame, spark.createDataFrame([("none", " . ")], "license string, text string"))


def plain_features(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    full = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_features(spark, docs, table):
    extra = [(500, "a b c d e f g h i\n" * 5, "a"), (501, "x | y ### <z>\nx | y ### <z>", "a")]
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", s, 1, "", "") for i, t, s in extra], SCHEMA))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20, 50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(both, labels)
    got = quality.score_quality(both, model).collect()
    want = collections.Counter((i, *plain_features(t)) for i, t, _ in table[0] + extra)
    assert collections.Counter((r[0], *r[1:7]) for r in got) == want
    assert quality.filter_quality(both, model).count() == sum(r["kept"] for r in got)
    none = quality.fit_quality(both, labels.where("quality = 1"))
    assert all(r["kept"] != r["base_failed"] for r in quality.score_quality(both, none).collect())


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.score_quality(docs, quality.fit_quality(docs, labels, rows=400)).join(labels, "doc_id").collect()
    good = [r for r in q if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.95 * len(good)
    assert sum(not r["kept"] for r in q if r["quality"] == 0) >= 0.8 * sum(r["quality"] == 0 for r in q)
    t = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    ones, zeros = ([r["score"] for r in t if r["toxic"] == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    w = toxicity.words_in(pa.array(["alpha beta gamma delta", "epsilon zeta eta theta iota", None]))
    place, row = toxicity.windows(w)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(rng, w, np.array([1, 0, 0]), np.ones(3, bool)).items()}
    x, mask = rng.normal(size=(3, toxicity.WINDOW, toxicity.INPUT)), (place >= 0).astype(float)
    g = rng.normal(size=3)
    _, kept = toxicity.forward(p, x, mask, keep=True)
    grads, gx = toxicity.backward(p, x, mask, kept, g)
    for name in ("w0", "u1", "b0", "wa", "va", "wo", "bo"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        sides = []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * 1e-3
            sides.append(float(toxicity.forward(q, x, mask)[0] @ g))
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at])), name


def test_toxicity_scores_every_row(spark, docs, table):
    got = toxicity.score_toxicity(docs, toxicity.ToxicityModel({}, constant=True)).collect()
    assert len(got) == len(table[0]) and {r["score"] for r in got} == {0.0}


def test_windows_overlap_and_cover():
    w = toxicity.words_in(pa.array([" ".join(f"a{k}" for k in range(200)), "", None]))
    place, row = toxicity.windows(w)
    seen = [set(place[k][place[k] >= 0]) for k in range(len(row))]
    assert set().union(*seen) == set(range(200)) and row.tolist()[-2:] == [1, 2]
    assert all(seen[k] & seen[k + 1] for k in range(sum(row == 0) - 1))


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>é{k}</p>" * (k % 5)) for k in range(300)] + [(5000, None, None), (5000, "twice", ""), (None, "n", "x\r\n\r\ny"), (7000, "http://x/a\nb\r\nc", "line")]
    rows += [(9000, "hot", f"<b>{k % 40}</b>") for k in range(600)] + [(None, None, f"{k}") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    back = {(r["page_id"], r["url"], r["html"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    clean = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    assert back == {(-1 if i is None else i, clean(u), h or "") for i, u, h in rows}
    leaf = [r for r in warc.leaves(warc.records(pages)).orderBy("archive", "page_id", "k").collect()]
    for a, b in zip(leaf, leaf[1:], strict=False):  # end to end in an archive, numbered in an id
        assert b["record_offset"] == (a["record_offset"] + a["length"] if a["archive"] == b["archive"] else 0)
        assert b["k"] == (a["k"] + 1 if a["page_id"] == b["page_id"] else 1)
    own = warc.records(pages)
    assert warc.audit(own, own).count() == 0
    found = {(r["page_id"], r["status"]) for r in warc.audit(own, warc.damaged(own)).collect()}
    assert {(7, "altered"), (57, "altered"), (123, "missing"), (124, "moved")} <= found and (122, "moved") not in found
    assert {r["status"] for r in warc.audit(own.where("page_id < 3"), own.where("page_id < 5")).collect()} == {"extra"}
    assert warc.audit(own, own.limit(0)).count() == len(rows) == warc.audit(own.limit(0), own).where("status = 'extra'").count()
    clash = pages.selectExpr("*", "1 as k", "2 as archive", "3 as part", "4 as sha256", "5 as record")
    assert warc.audit(warc.records(clash), own).count() == 0 == warc.audit(own.limit(0), own.limit(0)).count()


def test_packing(docs, table):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, with_ids=True)
    rows = got.collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for i, t, _ in table[0]:
        if i not in (None, 11):
            own = sorted(by_doc[i], key=lambda r: r["piece"])
            assert sum((r["ids"] for r in own), []) == [*library.encode(t or "", add_special_tokens=False).ids, 0]
            assert all(r["length"] == packing.CAPACITY for r in own[1:])
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / packing.CAPACITY) + 1
    assert packing.sequences(got).count() == len(bins)


@pytest.mark.parametrize("slots", [4, 1 << 18])
def test_text_encoder_equals_the_library(monkeypatch, slots):
    monkeypatch.setattr(packing, "SLOTS", slots)
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path(packing.TOKENIZER)
    encode, library = packing.TextEncoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "a  b", "a \n b", "x\n y", " lead", "tail ", "it's 'tis  ", "a\tb c  d", "　 x 　y", "1 2  3", "é ü\n\n z", "ab cd  e", "don't 'll ' s", None, "é\u00a0è \u00a0x", "a \u2003b", "x " + "y" * 300 + " y", "end\n next"]
    texts += [made(50, k) + " \n"[k % 2] + "ÀÉ «tres»"[: k % 9] for k in range(40)]
    for some in ([x] for x in texts), [texts], [texts]:  # alone, together, remembered
        for part in some:
            for t, ids in zip(part, encode(pa.array(part, pa.string())), strict=True):
                assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_text_encoder_knows_added_tokens():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path(packing.TOKENIZER)
    encode, library = packing.TextEncoder(path), Tokenizer.from_file(path)
    for t in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  ", "a <|endoftext | > b", "c\n<|endoftext|> "]:
        ids = [x.tolist() for x in encode(pa.array(["one two", t, None, "three"]))]
        assert ids == [library.encode(x, add_special_tokens=False).ids for x in ("one two", t, "", "three")], repr(t)
    assert 50256 in encode(pa.array(["a <|endoftext|> b"]))[0]


def test_plan_never_overfills():
    rng = np.random.default_rng(2)
    for cap in (7, 64):
        counts = rng.integers(0, 9, cap + 1)
        counts[0] = 0
        fill = collections.Counter()
        for length, _, n, first, offset in packing.plan(counts, cap):
            for k in range(n):
                assert fill[first + k] == offset
                fill[first + k] += length
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(counts * np.arange(cap + 1))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert brown.score(empty).count() == 0
    assert lines.duplicate_lines(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert exact.exact_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert licenses.scan_licenses(empty, licenses.template_table(spark)).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0
    import public_tokenizers as public

    assert packing.pack(empty, public.path(packing.TOKENIZER)).count() == 0


def dealt_anew(spark, df, cores=2):
    """The rows of a planned df, read by another number of cores than it was planned with."""
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
    try:
        return df.collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12).write.parquet(path)
    return spark.read.parquet(path)


def test_rows_keep_their_identity_when_dealt_anew(spark, many_files):
    for make in (exact.exact_duplicates, simhash.keep_first, mixing.take, mixing.mix, lines.without_duplicates):
        here = sorted(map(str, make(many_files).collect()))
        assert sorted(map(str, dealt_anew(spark, make(many_files)))) == here, make
        assert sorted(map(str, dealt_anew(spark, make(many_files), 40))) == here, make
    assert sum(r["kept"] for r in dealt_anew(spark, exact.exact_duplicates(many_files))) == many_files.select("text").distinct().count()


def test_toxicity_learns_despite_one_long_text(spark, docs, monkeypatch):
    base = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF[:-5]}0.1/labels.parquet")
    first = labels.where("toxic = 0").where(~toxicity.held_out()).orderBy("doc_id").first()["doc_id"]
    long = base.withColumn("text", toxicity.F.when(base["doc_id"] == first, toxicity.F.repeat(toxicity.F.lit("plain words again "), 1_700_000)).otherwise(base["text"]))
    model = toxicity.fit_toxicity(long, labels)
    assert not model.constant
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(base, model).where("held_out").collect()}
    known = [(scored[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in scored and r["toxic"] is not None]
    ones, zeros = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.9


def test_share_of_words():
    assert toxicity._share([5, 5], 100) == 5 and toxicity._share([10, 1000], 100) == 90 and toxicity._share([], 9) == 0
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes, most = rng.integers(0, 500, 20).tolist(), int(rng.integers(1, 5000))
        share = toxicity._share(sizes, most)
        assert sum(min(n, share) for n in sizes) <= most and (share >= max(sizes) or sum(min(n, share + 1) for n in sizes) > most)


def test_line_dedup_sends_files_by_a_long(spark, tmp_path, monkeypatch):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven", None, "one two three four five six seven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def found():
        plan = lines._placed(docs)._jdf.queryExecution().executedPlan().toString()
        return "input[0, bigint" in plan.split("HashedRelationBroadcastMode(List(")[1][:20], sorted(map(tuple, lines.duplicate_lines(docs).collect()))

    by_hash, got = found()
    assert by_hash and [r[2] for r in got] == [0, 1, 0, 0, 1]
    monkeypatch.setattr(lines, "path_hash", lambda path: F.length(path).cast("long"))  # files of one hash are known by their paths
    assert found() == (False, got)


def test_written_tables_keep_short_plans(spark):
    keys = "spark.sql.maxPlanStringLength", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = [spark.conf.get(k, None) for k in keys]
    materialise(spark.range(3).select("id", F.concat(F.col("id").cast("string"), F.lit("x" * 300_000)).alias("x")), "short-plan")
    assert [spark.conf.get(k, None) for k in keys] == was
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert ran.last().physicalPlanDescription().__len__() < 100_000


@pytest.mark.parametrize("name", ["quality", "simhash", "packing"])
def test_workers_hold_arrays_of_small_slices(monkeypatch, name):
    seen = []

    class Docs:  # takes the function of a task out of its plan
        columns, schema = ["doc_id", "text"], None

        def select(self, *cols):
            return self

        def mapInArrow(self, f, schema):
            return f

    module = {"quality": quality, "simhash": simhash, "packing": packing}[name]
    sliced = module.chunks
    monkeypatch.setattr(module, "chunks", lambda batch, *a, **k: [seen.append(x) or x for x in sliced(batch, *a, **k)])
    monkeypatch.setattr(module, "F", type("F", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda self, kind: c})())}))
    if name == "quality":
        task = quality.filter_quality(Docs(), quality.QualityModel(np.zeros((4, 1 << quality.BITS), np.float32), 1.0, 60.0))
    elif name == "simhash":
        monkeypatch.setattr(simhash, "_fingerprints", lambda texts, words: np.zeros(len(texts), np.uint64))
        task = simhash.fingerprints(Docs())
    else:
        monkeypatch.setattr(packing, "TextEncoder", lambda path: lambda column: [np.zeros(3, np.uint32)] * len(column))
        task = packing.tokenised(Docs(), "")
    texts = [f"{k} " + "some words of a text " * 100 for k in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1500)), "text": texts})
    list(task([batch]))
    assert sum(x.num_rows for x in seen) == 1500 and max(x.nbytes for x in seen) < 600_000


def test_prefix_rows_are_shuffled_as_four_longs(spark):
    words = [-(2**31), -1, 0, 7, 2**31 - 1]
    made = spark.createDataFrame([(5, 1, 2, lines.MOST, words), (6, 3, 4, 9, words[:2])], "id long, bits long, wide long, n int, prefix array<int>")
    rows = lines._prefix_rows(made)
    assert [kind for _, kind in rows.dtypes] == ["bigint"] * 4
    got = rows.select("id", "bits", "wide", lines._word("at"), lines._length("at"), F.col("at").bitwiseAND(F.lit(lines.MOST).cast("long"))).collect()
    assert sorted(map(tuple, got)) == sorted([(5, 1, 2, w, lines.MOST, k) for k, w in enumerate(words)] + [(6, 3, 4, w, 9, k) for k, w in enumerate(words[:2])])


def test_line_dedup_replaces_once_and_removes_empty_words_as_hashes(spark):
    texts = ["a  b\n\tc a", " ", None, "\x0bb\r\n"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    found = lines._all_words(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("replace(") == 1
    assert sorted(r[0] for r in found.collect() if r[0]) == ["a", "a", "b", "b", "c"]
    hashed = docs.select("text", lines._hashes(F.col("text")).alias("set"))
    want = {x: {r[0] for r in spark.createDataFrame([(w,) for w in set((x or "").split())], "w string").select(F.xxhash64("w")).collect()} for x in texts if x}
    got = {r[0]: r[1] for r in hashed.where("text is not null").collect()}
    assert {x: set(v) for x, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())


def test_line_dedup_shuffles_rows_of_the_second_join_once(docs, spark, monkeypatch):
    plans, write = {}, lines.materialise

    def kept(df, name, folder=None):
        if name == "line-met":
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, folder)

    monkeypatch.setattr(lines, "materialise", kept)
    # else a plan shows reuse only once it runs, and small tables are broadcast
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines.duplicate_lines(docs)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert "ReusedExchange [b_id" in plans["line-met"]
