"""Windows whose length is data, and an audit that a query never looks ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.columns import ordered

PAIR = ["pair"]
#: Variants that one plan takes; they travel inside it.
MOST_VARIANTS = 1000


def _levels(candles: DataFrame, value: str, better: Callable[..., Column], count: int, out: str) -> DataFrame:
    """candles with `out`, an array: at k the best value of the 2^k rows before a row, null where there are fewer."""
    w = ordered(PAIR)
    x = candles.withColumn(f"{out}_0", F.lag(value).over(w))
    for k in range(1, count):
        before = F.lag(f"{out}_{k - 1}", 1 << (k - 1)).over(w)
        # the earlier half is missing where rows are: best() would pass over it
        x = x.withColumn(f"{out}_{k}", F.when(before.isNotNull(), better(F.col(f"{out}_{k - 1}"), before)))
    names = [f"{out}_{k}" for k in range(count)]
    return x.withColumn(out, F.array(*names)).drop(*names)


def channel_variants(candles: DataFrame, variants: DataFrame) -> DataFrame:
    """pair, date, variant, entry_high, exit_low, enter, exit for every variant (variant, entry, exit: rows of a channel).

    Highs and lows of power-of-two lengths are built once for all variants. A channel of n rows is the best of two of the largest
    such length within it, one ending at the row and one n - 2^k rows before; the second comes from its own row by one shuffle
    that all variants share. Undefined channels, with fewer rows before, never signal.
    """
    rows = variants.select("variant", F.col("entry").cast("int"), F.col("exit").cast("int")).limit(MOST_VARIANTS + 1).collect()
    if len(rows) > MOST_VARIANTS or any(r["entry"] is None or r["exit"] is None or min(r["entry"], r["exit"]) < 1 for r in rows):
        raise ValueError(f"at most {MOST_VARIANTS} variants, with lengths of 1 or more")
    if not rows:
        return candles.sparkSession.createDataFrame([], "pair string, date timestamp_ntz, variant string, entry_high double, exit_low double, enter boolean, exit boolean")
    count = max(max(r["entry"], r["exit"]) for r in rows).bit_length()
    x = candles.select("pair", "date", "high", "low", "close").withColumn("i", F.row_number().over(ordered(PAIR)) - 1)
    x = _levels(_levels(x, "high", F.greatest, count, "highs"), "low", F.least, count, "lows")

    def spec(n: int) -> list[Column]:
        k = n.bit_length() - 1
        return [F.lit(k), F.lit(n - (1 << k))]

    every = F.array(*[F.struct(F.lit(r["variant"]).alias("variant"), *[c.alias(f"{s}_{p}") for s in ("entry", "exit") for c, p in zip(spec(r[s]), ("k", "shift"), strict=True)]) for r in rows])
    x = x.select("pair", "i", "date", "close", "highs", "lows", F.inline(every))
    high, low = F.get("highs", F.col("entry_k")), F.get("lows", F.col("exit_k"))
    none, gone = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    parts = F.array(
        F.struct(F.col("i").alias("at"), F.col("date").alias("date"), F.col("close").alias("close"), high.alias("h1"), low.alias("l1"), none.alias("h2"), none.alias("l2")),
        F.struct((F.col("i") + F.col("entry_shift")).alias("at"), gone.alias("date"), none.alias("close"), none.alias("h1"), none.alias("l1"), high.alias("h2"), none.alias("l2")),
        F.struct((F.col("i") + F.col("exit_shift")).alias("at"), gone.alias("date"), none.alias("close"), none.alias("h1"), none.alias("l1"), none.alias("h2"), low.alias("l2")),
    )
    met = x.select("pair", "variant", F.inline(parts)).groupBy("pair", "variant", "at").agg(*[F.max(c).alias(c) for c in ("date", "close", "h1", "l1", "h2", "l2")]).where("date is not null")
    out = met.select("pair", "date", "variant", "close", F.when(F.col("h2").isNotNull(), F.greatest("h1", "h2")).alias("entry_high"), F.when(F.col("l2").isNotNull(), F.least("l1", "l2")).alias("exit_low"))
    return out.select("pair", "date", "variant", "entry_high", "exit_low", F.coalesce(F.col("close") > F.col("entry_high"), F.lit(False)).alias("enter"), F.coalesce(F.col("close") < F.col("exit_low"), F.lit(False)).alias("exit"))


def prefix_audit(query: Callable[[DataFrame], DataFrame], candles: DataFrame, cuts: list[str], columns: list[str]) -> DataFrame:
    """pair, date, cut, column: where query's rows (pair, date, columns) on the candles before a cut differ from those on all candles.

    Each prefix is a pair of its own, so one run of the query makes the rows of all prefixes and of the whole. A row that only one
    of the two has differs in all columns. Nothing comes back from a query that looks at no later candle.
    """
    mark = "\x1f"
    times = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    runs = F.array(F.lit(""), *[F.when(F.col("date") < t, F.lit(c)) for c, t in zip(cuts, times, strict=True)])
    tagged = candles.withColumn("__cut", F.explode(F.array_compact(runs))).withColumn("pair", F.concat_ws(mark, "__cut", "pair")).drop("__cut")
    rows = query(tagged).select(F.substring_index("pair", mark, 1).alias("cut"), F.expr("substring(pair, instr(pair, '\x1f') + 1)").alias("pair"), "date", *columns)
    # the whole, once for each cut that a row comes before
    wanted = F.explode(F.when(F.col("cut") == "", F.array_compact(F.array(*[F.when(F.col("date") < t, F.lit(c)) for c, t in zip(cuts, times, strict=True)]))).otherwise(F.array("cut")))
    sides = rows.withColumn("whole", F.col("cut") == "").withColumn("cut", wanted)
    at = lambda c, whole: F.max_by(F.struct(F.col(c)), F.col("whole") == whole)
    both = sides.groupBy("pair", "date", "cut").agg(F.count_if("whole").alias("n1"), F.count_if(~F.col("whole")).alias("n0"), *[x for c in columns for x in (at(c, True).alias(f"{c}_1"), at(c, False).alias(f"{c}_0"))])
    differs = [F.when((F.col("n0") != F.col("n1")) | ~F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1")), F.lit(c)) for c in columns]
    return both.select("pair", "date", "cut", F.explode(F.array_compact(F.array(*differs))).alias("column"))


__all__ = ["channel_variants", "prefix_audit"]
