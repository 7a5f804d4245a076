"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

A source's documents are shuffled by a hash of their id (of the row's number where an id is null or repeated) and laid end to
end, for as many epochs as its target needs. A document's virtual finish time is its source's cumulative size divided by the
source's target, so all sources reach 1 together. All (document, epoch) items are then range-sorted by that time and cut where the total budget is reached.

Running sums are taken in two levels: sums by slice of the shuffle (or of the time), running over the few slices, then inside
each slice. So no window holds a whole source, however large.

Defined results: null text has size 0; size 0 takes 0; a null source is a source of its own, last; repeated rows are items of
their own; an empty table gives no rows; further columns are ignored by mix() and returned by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, placed, text_of, words_of

EPOCHS = 3
#: Slices of a running sum over all rows, the least, and the rows that a slice of a larger table holds on average.
SLICES, SLICE_ROWS = 4096, 50_000
#: A source table of more rows than this is joined by a shuffle.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, cap: float = EPOCHS) -> DataFrame:
    """source, no, source_size, target: weights 1, 2, 3, 1, ... by code point share all sizes, none above cap times its size.

    Sources in order of cap * size / weight: the first ones are capped as long as that is below the level that the rest
    share. One row a source, so the windows over all sources stay small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by_source = by_source.withColumn("weight", ((F.col("no") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "no")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / F.sum("weight").over(rest)
    by_source = by_source.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    shared = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by_source.select("source", "no", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(shared * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list[str], slice_of: Column, order: list[str], size: str, out: str) -> DataFrame:
    """df with out, the running sum of size in each group by (slice, order), without a window over a whole group."""
    df = df.withColumn("slice", slice_of)
    sums = df.groupBy(*group, "slice").agg(F.sum(size).alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, "slice", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum(size).over(Window.partitionBy(*group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("inside", inside).join(sums, [*group, "slice"]).withColumn(out, F.col("before") + F.col("inside")).drop("slice", "before", "inside")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, source, size and more. Written, so that a row keeps its number."""
    row = F.monotonically_increasing_id().alias("row")
    return materialise(docs.select(row, F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words_of(text_of())).cast("long").alias("size"), *more), "mix-sizes")


def _taken(sized: DataFrame, seed: str) -> DataFrame:
    """sized (row, doc_id, source, size, a written table) with source_size, target and taken."""
    sized = sized.select("row", "doc_id", "source", "size")
    targets = materialise(source_targets(sized), "mix-targets")
    few = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    docs = sized.join(few.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    slices = max(SLICES, sized.count() // SLICE_ROWS)
    # written, so that its size is known: a small one is broadcast by Spark's own check and the rows aren't shuffled to it
    repeated = materialise(sized.groupBy(F.col("doc_id").alias("other")).count().where("count > 1").select("other", F.lit(True).alias("again")), "mix-repeated")
    live = docs.where("size > 0 and target > 0").join(repeated, F.col("doc_id").eqNullSafe(F.col("other")), "left").drop("other")
    # an id of one row only decides its place; rows without such an id are spread by their number
    own = F.when(F.col("again"), F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("row"), F.col("row").cast("string"))).otherwise(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    live = live.withColumn("shuffle", F.md5(F.concat_ws(":", F.lit(seed), own))).drop("again")
    eighth = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    live = _running(live, ["no"], F.shiftright(eighth * F.lit(slices), 32).cast("int"), ["shuffle", "row"], "size", "through")
    items = live.select("row", "size", "doc_id", "shuffle", "source_size", "through", "target", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)).alias("epoch"))
    time = (F.col("epoch") * F.col("source_size") + F.col("through")) / F.col("target")
    items = items.select(F.lit(0).alias("all"), "row", "size", "shuffle", "epoch", time.alias("time"))
    items = _running(items, ["all"], F.floor(F.col("time") / (1 + F.col("time")) * slices).cast("int"), ["time", "shuffle", "row", "epoch"], "size", "total")
    budget = targets.agg(F.coalesce(F.round(F.sum("target"), 3), F.lit(0.0))).first()[0]
    took = items.where(F.col("total") <= F.lit(budget)).groupBy("row").agg(F.sum("size").alias("taken"))
    return docs.join(took, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    return _taken(_sized(docs), seed).drop("row")


def take(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as many times as the mix takes it, with all its columns. What is no scan of Parquet files is written first."""
    file, at, times = (fresh(docs, c) for c in ("file", "at", "times"))
    docs = placed(docs, file, at)
    sized = _sized(docs, F.col(file).alias("file"), F.col(at).alias("at"))
    took = _taken(sized, seed).where("taken > 0").select("row", F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")).alias("times"))
    took = sized.select("row", "file", "at").join(took, "row").select(F.col("file").alias(file), F.col("at").alias(at), F.col("times").alias(times))
    return docs.join(took, [file, at]).withColumn(times, F.explode(times)).drop(file, at, times)


#: The same in DuckDB: running sums as plain windows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT *, CAST((no - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source)
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src
), shared AS (SELECT arg_min(level, most / weight) AS level FROM leveled WHERE most > level * weight
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.most <= l.level * l.weight THEN l.most ELSE s.level * l.weight END AS target FROM leveled l LEFT JOIN shared s ON true
), docs AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS shuffle
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), live AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY shuffle ROWS UNBOUNDED PRECEDING) AS through FROM docs WHERE size > 0 AND target > 0
), items AS (
  SELECT doc_id, size, shuffle, epoch, CAST(epoch * source_size + through AS DOUBLE) / target AS time
  FROM (SELECT *, unnest(range(CAST(ceil(target / source_size) AS BIGINT))) AS epoch FROM live)
), took AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM (
    SELECT doc_id, size, sum(size) OVER (ORDER BY time, shuffle, epoch ROWS UNBOUNDED PRECEDING) AS total FROM items)
  WHERE total <= (SELECT round(sum(target), 3) FROM targets) GROUP BY doc_id
)
SELECT d.doc_id, d.size, d.source_size, round(d.target, 6) AS target, coalesce(t.taken, 0) AS taken FROM docs d LEFT JOIN took t USING (doc_id)
"""
