"""Stylized facts of returns by period: overlapping periods in one pass, shuffle ranges without a series in one row.

Periods are half-open and may overlap, touch or be empty; "full" is added. A candle is placed by binary search in the sorted
boundaries, compiled into an expression, and goes to all periods that cover the stretch it falls in. All facts are then aggregated
by (pair, period) from the same returns; a period's first candle has no return.

A shuffle range needs whole permutations of a series. Each replicate is the returns sorted by a scrambled number of (replicate,
place), in a window by (pair, period, replicate); scaling and entropy of all replicates, of the returns and of their sizes come
from the same two aggregations.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import ratio

from .resample import A, C, M
from .structure import BOX_POINTS, LEAST_BOX, box_sizes, fluctuations, hill_tail, patterns

KEYS = ["pair", "period"]
#: Lags of the autocorrelations, and the largest one of the intermittency fit.
LAGS, MAX_LAG = (1, 2, 6, 30), 120
#: The returns themselves and their sizes, beside replicates 0, 1, ...
OWN, SIZES = -1, -2


def _stretch(at: Column, bounds: list[Column], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted bounds are at or before `at`: a binary search as nested conditions."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(at < bounds[middle], _stretch(at, bounds, low, middle)).otherwise(_stretch(at, bounds, middle + 1, high))


def in_periods(rows: DataFrame, periods: list[tuple[str, str, str]], at: str = "date") -> DataFrame:
    """rows with period, once for each period (name, from, to) that holds their time, and once as "full"."""
    times = sorted({t for _, a, b in periods for t in (a, b)})
    covers = [["full"] for _ in range(len(times) + 1)]
    for name, a, b in periods:
        for k in range(bisect_right(times, a), bisect_right(times, b)):  # empty if it ends where it begins, or before
            covers[k].append(name)
    names = F.array(*[F.array(*map(F.lit, c)) for c in covers])
    where = _stretch(F.col(at), [F.lit(t).cast("timestamp_ntz") for t in times])
    return rows.withColumn("period", F.explode(F.get(names, where)))


def scrambled(x: Column) -> Column:
    """A number below 2^31 for a whole number: two steps of the generator with folded bits between, so that neighbours part."""
    for shift in (15, 13):
        x = (x * A + C) % M
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return (x * A + C) % M


def variants(returns: DataFrame, keys: list[str], reps: int) -> DataFrame:
    """keys, rep, i, n, x of returns (keys, i, n, r): the returns (OWN), their sizes (SIZES), and `reps` permutations of the returns."""
    n = F.col("n").cast("long")
    each = returns.select(*keys, "n", F.col("i").cast("long").alias("place"), "r", F.explode(F.sequence(F.lit(SIZES), F.lit(reps - 1))).alias("rep"))
    key = F.when(F.col("rep") < 0, F.col("place")).otherwise(scrambled(F.col("rep") * n + F.col("place")))
    order = Window.partitionBy(*keys, "rep").orderBy("key", "place")
    return each.withColumn("key", key).select(*keys, "rep", (F.row_number().over(order) - 1).alias("i"), "n", F.when(F.col("rep") == SIZES, F.abs("r")).otherwise(F.col("r")).alias("x"))


def _ranges(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and name (of the returns), name_sizes, name_low and name_high (2.5 and 97.5 % over replicates) of values (keys, rep, value)."""
    at = lambda rep: F.max(F.when(F.col("rep") == rep, F.col("value")))
    both = F.percentile(F.when(F.col("rep") >= 0, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))
    out = values.groupBy(*keys).agg(at(OWN).alias(name), at(SIZES).alias(f"{name}_sizes"), both.alias("both"))
    return out.select(*keys, name, f"{name}_sizes", F.get("both", F.lit(0)).alias(f"{name}_low"), F.get("both", F.lit(1)).alias(f"{name}_high"))


def shuffle_ranges(returns: DataFrame, keys: list[str], reps: int = 200) -> DataFrame:
    """keys, hurst, hurst_sizes, hurst_low, hurst_high, entropy, entropy_low, entropy_high of returns (keys, i, n, r).

    Null where the scales of the fluctuations or an ordinal pattern don't fit into the series.
    """
    own = variants(returns, keys, reps)
    rep = [*keys, "rep"]
    hurst = _ranges(fluctuations(own, rep).select(*rep, F.col("hurst").alias("value")), keys, "hurst")
    entropy = _ranges(patterns(own, rep).select(*rep, F.col("entropy").alias("value")), keys, "entropy").drop("entropy_sizes")
    return hurst.join(entropy, keys, "full_outer")


def _one_pass(returns: DataFrame, keys: list[str], per_year: float) -> DataFrame:
    """Moments, autocorrelations and intermittency of returns (keys, i, n, r): one window by series, one aggregation."""
    all_, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("i")
    least = F.min(F.when(F.col("r") != 0, F.abs("r"))).over(all_)
    y = F.ln(F.when(F.col("r") != 0, F.abs("r")).otherwise(least))
    d = returns.withColumns({"d": F.col("r") - F.avg("r").over(all_), "s": F.abs("r") - F.avg(F.abs("r")).over(all_), "y": y})
    d = d.withColumn("y", F.col("y") - F.avg("y").over(all_))
    lags = {"d": LAGS, "s": LAGS, "y": range(1, MAX_LAG + 1)}
    d = d.select(*keys, "n", "r", *lags, *[F.lag(c, k).over(w).alias(f"{c}{k}") for c, ks in lags.items() for k in ks])
    products = [F.sum(F.col(c) * F.col(f"{c}{k}")).alias(f"{c}{k}") for c, ks in lags.items() for k in ks]
    squares = [F.sum(F.col(c) * F.col(c)).alias(f"{c}0") for c in ("d", "s")]
    sums = d.groupBy(*keys, "n").agg(F.stddev_pop("r").alias("sd"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"), *squares, *products)
    acf = [F.when(F.col(f"{c}0") > 0, F.coalesce(F.col(f"{c}{k}"), F.lit(0.0)) / F.col(f"{c}0")).otherwise(0.0).alias(f"acf_{'abs_' if c == 's' else ''}{k}") for c in ("d", "s") for k in LAGS]
    flat = F.col("sd") == 0
    cov = F.array(*[F.struct((-F.ln(F.lit(float(k)))).alias("x"), (F.col(f"y{k}") / (F.col("n") - k)).alias("cov")) for k in range(1, MAX_LAG + 1)])
    facts = sums.select(
        *keys, "n", (F.col("sd") * math.sqrt(per_year) * 100).alias("volatility_pct"), F.when(flat, 0.0).otherwise(F.col("skewness")).alias("skewness"), F.when(flat, -3.0).otherwise(F.col("excess_kurtosis")).alias("excess_kurtosis"), *acf,
        F.when(F.col("n") > MAX_LAG, cov).alias("cov"),
    )
    fit = facts.select(*keys, "n", F.inline("cov")).groupBy(*keys, "n").agg(F.regr_slope("cov", "x").alias("lambda2"), F.regr_intercept("cov", "x").alias("start"))
    scale = F.least(F.greatest(F.exp(F.least(ratio(F.col("start"), F.col("lambda2")), F.lit(700.0))), F.lit(float(MAX_LAG))), 10.0 * F.col("n"))
    fit = fit.select(*keys, "lambda2", F.when(F.col("lambda2") > 0, scale).alias("integral_scale"))
    return facts.drop("cov").join(fit, keys, "left")


def period_returns(candles: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """pair, period, date, i, n, r: log returns inside each period."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    r = F.ln("close") - F.ln(F.lag("close").over(w))
    rows = in_periods(candles.select("pair", "date", "close"), periods).withColumns({"r": r, "i": F.row_number().over(w) - 2, "n": F.count("*").over(Window.partitionBy(*KEYS)) - 1})
    return rows.where("i >= 0").select(*KEYS, "date", "i", "n", "r")


def stylized_facts(candles: DataFrame, periods: list[tuple[str, str, str]], per_year: float, reps: int = 200) -> DataFrame:
    """One row for each pair and period: its candles, facts, and `refused`, why there are none (null: there are).

    A period without enough losses or gains for the tail index has none of the facts, as a study of it would be refused. Nor has
    one that is too short for the largest lag or the scales.
    """
    spans = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).cast("string").alias("start"), F.lit(b).cast("string").alias("end")) for n, a, b in [*periods, ("full", None, None)]])
    every = candles.select("pair").distinct().select("pair", F.inline(spans))
    returns = period_returns(candles, periods)
    counted = in_periods(candles.select("pair", "date"), periods).groupBy(*KEYS).agg(F.count("*").alias("candles"))
    facts = _one_pass(returns, KEYS, per_year).join(hill_tail(returns, KEYS), KEYS, "left").join(shuffle_ranges(returns, KEYS, reps), KEYS, "left")
    x = every.join(counted, KEYS, "left").join(facts.drop("n"), KEYS, "left").withColumn("candles", F.coalesce("candles", F.lit(0)))
    n = F.col("candles") - 1
    refused = F.when(F.col("candles") == 0, "no candles").when(F.col("left").isNull() | F.col("right").isNull(), "too few tail observations").when((n <= MAX_LAG) | (n < 4 * LEAST_BOX), "too short")
    x = x.withColumn("refused", refused)
    sizes = box_sizes(n)
    x = x.withColumns({"scale_min": F.array_min(sizes).cast("long"), "scale_max": F.array_max(sizes).cast("long")})
    shown = ["volatility_pct", "skewness", "excess_kurtosis", "left", "right", "k", *[f"acf_{a}{k}" for a in ("", "abs_") for k in LAGS], "hurst", "hurst_sizes", "hurst_low", "hurst_high", "scale_min", "scale_max", "entropy", "entropy_low", "entropy_high", "lambda2", "integral_scale"]
    return x.select(*KEYS, "start", "end", F.col("candles").cast("long").alias("candles"), *[F.when(F.col("refused").isNull(), F.col(c)).alias({"left": "tail_left", "right": "tail_right", "k": "tail_k"}.get(c, c)) for c in shown], "refused")


__all__ = ["BOX_POINTS", "in_periods", "period_returns", "scrambled", "shuffle_ranges", "stylized_facts", "variants"]
