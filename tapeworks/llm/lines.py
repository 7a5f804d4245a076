"""Line dedup as an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. A line is removed if an earlier line (by doc_id, then row, then line number) has the same text or a
Jaccard similarity of THRESHOLD or more with it. Lines without a word have no set and stay.

1. Word rarity: counts in 2^18 slots of the word hash, a table of fixed size, order the words of every line (ties by hash).
2. Equal lines become one class, and so do lines of under LEAST_JOINED different words with equal sets: such sets come within
   the threshold of no other set (three of four words are 0.75, but four of five are 0.8, so lines of four words go on). A pair
   of classes within the threshold shares a word among the first n - ceil(t n) + 1 of each, so classes meet on those prefix
   words. In order of its id, each class is tried against the first class on each of its prefix words and the LAST ones before
   it: pairs that pass the length, the positional and a parity bitmap filter (128 bits; differing ones never exceed differing
   words) are candidates. Word sets are read again and compared exactly, the closest candidate of a class first.
3. The classes not yet settled meet all earlier ones on each prefix word, by the same filters. The prefix words that a pair has in common are counted, and it goes on to the exact comparison only if they
   and the words after its prefixes suffice. A pair that was tried on another word may be counted short, but is settled already.

None of the filters loses a pair. What is settled needs no second reason for removal, so no result changes, and in a cluster of
m near copies nearly all are settled by the few comparisons of step 2: the cluster doesn't emit its pairs.

Each row is a document of its own: it gets a number by its doc_id (nulls last), and rows of one doc_id by their place in the
files. A table that is no plain scan of Parquet files is written first, so that every reading of it finds the same places.

Defined results: null text counts as empty; rows that repeat a doc_id, or have none, are compared as any others; an empty
table gives no rows; further columns are ignored by duplicate_lines() and returned by without_duplicates(); a line's
number takes as many bits as the longest text could need and its row's number the rest of 63; tables beyond that raise an error
(with texts of up to 16 million characters that is 2^39 rows).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pinned, placed, scratch, split_words, text_of, words_of

THRESHOLD = 0.8
WORD = r"[^\x20\x09-\x0D]"
#: Sets of fewer words are within THRESHOLD of equal sets only.
LEAST_JOINED = 4
SLOTS = 18
LAST = 4
MOST = 65535
#: Places within a file, in bits of a row's place.
AT_BITS = 40
#: A table of at most so many ids (16 MB), or files, is broadcast; a larger one is joined by a shuffle.
BROADCAST_IDS, BROADCAST_FILES = 2_000_000, 100_000


def path_hash(path: Column) -> Column:
    return F.xxhash64(path)


def _placed(docs: DataFrame) -> DataFrame:
    """docs and __place, a number of each row's place in the files, the same at every reading.

    Files are known by a hash of their path, or by the path itself if two share a hash: for a broadcast whose key is no long the
    driver takes 64 MB, and the files are broadcast at each reading.
    """
    spark = docs.sparkSession
    docs = placed(docs, "__path", "__at")
    paths = sorted(map(tuple, docs.select("__path", path_hash(F.col("__path"))).distinct().collect()))  # one row a file
    kind, keys = "string", [x for x, _ in paths]
    if len({h for _, h in paths}) == len(paths):
        docs, kind, keys = docs.withColumn("__path", path_hash(F.col("__path"))), "long", [h for _, h in paths]
    files = spark.createDataFrame([(x, k) for k, x in enumerate(keys)], f"__path {kind}, __file long")
    place = F.shiftleft("__file", AT_BITS).bitwiseOR(F.col("__at"))
    files = F.broadcast(files) if len(paths) <= BROADCAST_FILES else files
    return docs.join(files, "__path").withColumn("__place", place).drop("__path", "__file", "__at")


def _line_bits(rows: DataFrame) -> int:
    """Bits that any line's number within its text fits into."""
    return max(1, int(rows.agg(F.max(F.length("text"))).first()[0] or 0).bit_length())


def _ranks(rows: DataFrame, folder: str, bits: int) -> DataFrame:
    """__place, doc: the rows' numbers from 0, by doc_id and place, nulls last, with so many zero bits after them."""
    order = rows.select(F.col("doc_id").cast("long").alias("key"), "__place").orderBy(F.col("key").asc_nulls_last(), "__place")
    dealt = materialise(order.select("__place", F.monotonically_increasing_id().alias("at")), "row-order", folder)
    task = F.shiftright("at", 33)
    sizes = sorted(dealt.groupBy(task.alias("task")).count().collect())  # one row a task
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    if total > 1 << (63 - bits):
        raise ValueError(f"more than 2^{63 - bits} rows, with lines of {bits} bits")
    starts = rows.sparkSession.createDataFrame(starts, "task long, start long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(dealt.withColumn("task", task).join(F.broadcast(starts), "task").select("__place", F.shiftleft(F.col("start") + within, bits).alias("doc")), "row-ranks", folder)


def _id(no: Column) -> Column:
    """A line's id, never negative: ids of later documents, and of later lines in one, are larger."""
    return F.col("doc").bitwiseOR(no.cast("long"))


def _lines(docs: DataFrame) -> DataFrame:
    """id, line."""
    return docs.select("doc", F.posexplode(F.split(text_of(), "\n")).alias("no", "line")).select(_id(F.col("no")).alias("id"), "line")


def _all_words(docs: DataFrame) -> DataFrame:
    """word: every word of every text, and empty ones, which no other word minds."""
    texts = docs.select(F.replace(text_of(), F.lit("\n"), F.lit(" ")).alias("text"))  # by itself: explode() would replace once for each mention
    return texts.select(F.explode(split_words(F.col("text"))).alias("word"))


def rarity(docs: DataFrame) -> Column:
    """array<tinyint>, a constant: for each slot a level that grows with the count of its words."""
    counts = _all_words(docs).select(F.xxhash64("word").bitwiseAND(F.lit((1 << SLOTS) - 1)).alias("slot")).groupBy("slot").count()
    # slots of a block in one row each, its slot above the seven bits of its level
    packed = F.shiftleft("slot", 7).bitwiseOR(F.floor(F.log2(F.col("count") + 1) * 3).cast("long"))
    level = [0] * (1 << SLOTS)
    for (block,) in counts.groupBy(F.shiftright("slot", SLOTS // 2).alias("block")).agg(F.collect_list(packed).alias("slots")).select("slots").collect():  # of a fixed size
        for x in block:
            level[x >> 7] = x & 127
    return F.from_json(F.lit(json.dumps(level, separators=(",", ":"))), "array<tinyint>")


def _hashes(line: Column) -> Column:
    """The line's set as its words' hashes. Empty words are removed as longs, which is faster than as strings."""
    return F.array_remove(F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _ranked(line: Column, rare: Column) -> Column:
    """The line's set as longs, rarest first: 7 bits of rarity over 56 bits of the word's hash."""

    def code(h: Column) -> Column:
        level = F.coalesce(F.get(rare, h.bitwiseAND(F.lit((1 << SLOTS) - 1)).cast("int")), F.lit(0).cast("tinyint"))  # never null: longs sort faster so
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(_hashes(line), code))


def _least_common(n: Column) -> Column:
    """Words that two lines with n words together must share."""
    return F.ceil(n * F.lit(THRESHOLD / (1 + THRESHOLD)) - F.lit(1e-9))


def coded_lines(docs: DataFrame, rare: Column, folder: str | None = None) -> DataFrame:
    """id, key1, key2 (of the text, or of the set if that is under LEAST_JOINED words), bits, wide, n, prefix of each line with a word.

    bits and wide are parities: bit k is set if an odd number of the line's words hash to k. n is the number of words (MOST for
    as many or more), prefix the prefix words as 32 bits of their hashes, none for sets under LEAST_JOINED words.
    """
    lines = _lines(docs).where(F.col("line").rlike(WORD))  # a condition on the set would have it worked out twice
    lines = lines.select("id", "line", _ranked(F.col("line"), rare).alias("set")).select("*", F.size("set").alias("n"))
    prefix = F.slice("set", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(THRESHOLD) - F.lit(1e-9)) + 1).cast("int"))
    short = F.col("n") < LEAST_JOINED
    prefix = F.when(short, F.array().cast("array<int>")).otherwise(F.transform(prefix, lambda w: F.shiftright(F.shiftleft(w, 32), 32).cast("int")))
    # a set as text: its words never hold a space, and no text of more words has the same set
    text = F.when(short, F.array_join(F.array_sort(F.array_distinct(words_of(F.col("line")))), " ")).otherwise(F.col("line"))
    keys = lines.select("id", "n", "set", text.alias("text"), prefix.alias("prefix"), _parity(False).alias("all"), _parity(True).alias("wide"))
    out = keys.select("id", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2"), F.col("all").bitwiseXOR(F.col("wide")).alias("bits"), "wide", F.least("n", F.lit(MOST)).alias("n"), "prefix")
    return materialise(out, "lines", folder)


def _parity(half: bool) -> Column:
    """A bit for each word of the set, by its hash's low six bits, flipped again by the next one; half: of words with the seventh bit set."""

    def flipped(a: Column, w: Column) -> Column:
        one = F.shiftright(w, 6).bitwiseAND(F.lit(1).cast("long")) if half else F.lit(1).cast("long")
        return a.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate("set", F.lit(0).cast("long"), flipped)


def _prefix_rows(lines: DataFrame) -> DataFrame:
    """id, bits, wide, at: a row for each prefix word; at has the word, then n (16 bits), then the place in the prefix (16 bits).

    One long for all three: these rows are shuffled twice, and a column of its own takes eight bytes of each.
    """
    rows = lines.select("id", "bits", "wide", "n", F.posexplode("prefix").alias("place", "word"))
    place = F.shiftleft(F.col("n").cast("long"), 16).bitwiseOR(F.least("place", F.lit(MOST)).cast("long"))
    return rows.select("id", "bits", "wide", F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(place).alias("at"))


def _word(at: str) -> Column:
    return F.shiftright(at, 32)


def _length(at: str) -> Column:
    return F.shiftright(at, 16).bitwiseAND(F.lit(MOST).cast("long")).cast("int")


def _differ(a: str, b: str) -> Column:
    """At least so many words are in one of two lines only."""
    return F.bit_count(F.col(f"{a}bits").bitwiseXOR(F.col(f"{b}bits"))) + F.bit_count(F.col(f"{a}wide").bitwiseXOR(F.col(f"{b}wide")))


def _passes(a: str, b: str) -> Column:
    """Length, positional and bitmap filter for prefix rows a and b; lines of MOST words or more always pass."""
    n, m = _length(f"{a}at"), _length(f"{b}at")
    i, j = (F.col(f"{x}at").bitwiseAND(F.lit(MOST).cast("long")).cast("int") for x in (a, b))
    share = (n + m) * F.lit(THRESHOLD / (1 + THRESHOLD)) - F.lit(1e-9)
    length = (n >= m * F.lit(THRESHOLD) - F.lit(1e-9)) & (m >= n * F.lit(THRESHOLD) - F.lit(1e-9))
    position = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= share
    return (n == MOST) | (m == MOST) | (length & position & (_differ(a, b) <= n + m - 2 * share))


def _enough(met: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix words, of a row for each shared one that passed, with their lengths n and m.

    Any other word that both have comes after the prefix whose last word is the rarer one, so there are at most as many of those
    as that line has words after its prefix. Hashes that collide only raise the count.
    """

    def after(n: str) -> Column:
        return F.ceil(F.col(n) * F.lit(THRESHOLD) - F.lit(1e-9)) - 1

    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    suffice = F.col("shared") + F.greatest(after("n"), after("m")) >= _least_common(F.col("n") + F.col("m"))
    return pairs.where((F.col("n") == MOST) | (F.col("m") == MOST) | suffice)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(ids: DataFrame, docs: DataFrame, name: str, folder: str) -> DataFrame:
    """id, set: the hashes of the words of lines."""
    return materialise(_lines(docs).join(_small(ids), "id").select("id", _hashes(F.col("line")).alias("set")), name, folder)


def _verified(pairs: DataFrame, sets: DataFrame, name: str, folder: str) -> DataFrame:
    """The later ids of those different pairs (a, b) whose sets are within the threshold."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialise(both.where(common >= _least_common(F.size("x") + F.size("y"))).select(F.greatest("a", "b").alias("id")).distinct(), name, folder)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def duplicate_classes(docs: DataFrame, lines: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of coded_lines(): key1, key2, id (of the earliest line), copies of each different line; ids of those an earlier one comes near."""
    every = materialise(lines.groupBy("key1", "key2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "line-classes", folder)
    repeated = every.where("copies > 1").select("key1", "key2", F.col("id").alias("first"))
    copies = materialise(lines.select("id", "key1", "key2").join(repeated, ["key1", "key2"]).where("id <> first").select("id"), "line-copies", folder)
    firsts = lines.join(_small(copies), "id", "left_anti")

    rows, by_word = _prefix_rows(firsts), Window.partitionBy("word").orderBy("id")
    own, rank = F.struct(*[F.col(c).alias(f"a_{c}") for c in rows.columns]), F.row_number().over(by_word)
    by_words = rows.repartition(_word("at")).withColumn("word", _word("at"))  # the word is taken out after the shuffle
    first = F.when(rank > LAST + 1, F.first(own).over(by_word.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = by_words.select("*", rank.alias("rank"), F.array(first, *[F.lag(own, k).over(by_word) for k in range(1, LAST + 1)]).alias("before")).where("rank > 1")
    tried = before.select(*rows.columns, F.inline("before")).where((F.col("a_id") < F.col("id")) & _passes("a_", ""))
    pairs = tried.select(F.col("a_id").alias("a"), F.col("id").alias("b"), _differ("a_", "").alias("differ")).groupBy("a", "b").agg(F.min("differ").alias("differ"))
    with scratch(docs.sparkSession) as till_settled:  # these tables go before the larger join
        pairs = materialise(pairs, "line-pairs", till_settled)
        sets = _sets(_ends(pairs), docs, "line-sets", till_settled)
        closest = _verified(pairs.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")), sets, "lines-closest", folder)
        others = _verified(pairs.join(_small(closest), F.col("b") == closest["id"], "left_anti"), sets, "lines-others", folder)
    settled = closest.unionByName(others)

    # settled lines have their id as -1 - id and seek no more. Both sides of the join are the same rows, so they are shuffled once
    marked = firsts.join(_small(settled.withColumn("settled", F.lit(True))), "id", "left")
    rows = _prefix_rows(marked.withColumn("id", F.when(F.col("settled"), -1 - F.col("id")).otherwise(F.col("id"))))
    for c in rows.columns:  # none is null; left to Spark, it asks that of other columns on each side and shuffles both
        rows = rows.where(F.col(c).isNotNull())
    a, b = rows.toDF(*[f"a_{c}" for c in rows.columns]), rows.toDF(*[f"b_{c}" for c in rows.columns])
    early = F.when(F.col("a_id") < 0, -1 - F.col("a_id")).otherwise(F.col("a_id"))
    met = a.join(b, (_word("a_at") == _word("b_at")) & (early < F.col("b_id")) & _passes("a_", "b_")).withColumn("a_id", early)
    met = materialise(_enough(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), _length("a_at").alias("n"), _length("b_at").alias("m"))), "line-met", folder)
    return every, settled.unionByName(_verified(met, _sets(_ends(met), docs, "line-more-sets", folder), "lines-met", folder)).distinct()


def removed_lines(rows: DataFrame) -> DataFrame:
    """Of rows (__place, doc_id, text): __place and removed, the numbers of its lines to remove, ascending. A table in the shared folder."""
    with scratch(rows.sparkSession) as folder:
        bits = _line_bits(rows)
        ranks = _ranks(rows, folder, bits)
        few = ranks.count() <= BROADCAST_IDS
        docs = rows.select("__place", "text").join(F.broadcast(ranks) if few else ranks, "__place").select("doc", "text")
        if not few:  # texts are shuffled to their numbers once, not at each reading
            docs = materialise(docs, "numbered-docs", folder)
        lines = coded_lines(docs, rarity(rows), folder)
        every, near = duplicate_classes(docs, lines, folder)
        gone = every.join(near.withColumn("gone", F.lit(True)), "id", "left").where(F.col("gone") | (F.col("copies") > 1))
        gone = gone.select("key1", "key2", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("id")).alias("keep"))
        out = lines.select("id", "key1", "key2").join(gone, ["key1", "key2"]).where(F.col("keep").isNull() | (F.col("id") != F.col("keep")))
        no = F.col("id").bitwiseAND(F.lit((1 << bits) - 1))
        by_row = out.groupBy((F.col("id") - no).alias("doc")).agg(F.sort_array(F.collect_list(no.cast("int"))).alias("removed"))
        return materialise(by_row.join(ranks, "doc").select("__place", "removed"), "lines-removed")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0): one row for each row of docs."""
    rows = _placed(docs.select("doc_id", "text"))
    counted = rows.select(F.col("doc_id").cast("long"), "__place", F.size(F.split(text_of(), "\n")).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.join(removed_lines(rows), "__place", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the lines removed from their text; a document of which no word is left goes. All columns are returned."""
    names, own = docs.columns, [f"c{k}" for k in range(len(docs.columns))]  # helpers and columns can't clash
    at = {c.lower(): x for c, x in zip(names, own, strict=True)}
    docs = pinned(docs).toDF(*own)
    rows = _placed(docs.select("*", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")))
    gone = removed_lines(rows.select("__place", "doc_id", "text"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("removed", k)), "\n")
    left = rows.join(gone, "__place", "left").withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept))
    left = left.where(F.col("removed").isNull() | F.col("text").rlike(WORD))
    return left.select(*[F.col("text" if x == at["text"] else x).alias(c) for c, x in zip(names, own, strict=True)])
