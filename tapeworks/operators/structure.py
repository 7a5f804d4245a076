"""Structure of return series (keys, date, r): tails, autocorrelation, scaling, ordinal patterns, intermittency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import ordered, ratio


def numbered(returns: DataFrame, keys: list[str]) -> DataFrame:
    """returns with i (0, 1, ...) and n, the series' length."""
    return returns.withColumns({"i": F.row_number().over(ordered(keys)) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})


#: Bins of the size of a return for each doubling, by which the largest are found before any are ranked.
TAIL_BINS = 16


def hill_tail(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, left, right: Hill index of the max(20, 5 %) largest losses and gains; null where a tail is shorter.

    Counts by bins of the size tell which bins hold the k + 1 largest; only rows in those are ranked.
    """
    side = [*keys, "side"]
    size = returns.groupBy(*keys).agg(F.greatest(F.lit(20), F.floor(F.count("*") * 0.05)).alias("k"))
    x = F.abs("r")
    tails = returns.where("r <> 0").select(*keys, F.when(F.col("r") < 0, "left").otherwise("right").alias("side"), x.alias("x"), F.floor(F.log2(x) * TAIL_BINS).alias("bin"))
    above = F.sum("m").over(Window.partitionBy(*side).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    bins = tails.groupBy(*side, "bin").agg(F.count("*").alias("m")).withColumn("above", F.coalesce(above, F.lit(0)))
    bins = bins.join(size, keys).where(F.col("above") <= F.col("k")).select(*side, "bin", "k", "above")
    rank = F.col("above") + F.row_number().over(Window.partitionBy(*side, "bin").orderBy(F.desc("x")))
    t = tails.join(bins, [*side, "bin"]).withColumn("rank", rank).where(F.col("rank") <= F.col("k") + 1)
    limit = F.max(F.when(F.col("rank") == F.col("k") + 1, F.col("x")))
    logs = t.groupBy(*side, "k").agg(ratio(F.lit(1.0), F.sum(F.when(F.col("rank") <= F.col("k"), F.ln("x"))) / F.col("k") - F.ln(limit)).alias("alpha"))
    each = [F.max(F.when(F.col("side") == s, F.col("alpha"))).alias(s) for s in ("left", "right")]
    return size.join(logs.groupBy(*keys).agg(*each), keys, "left").select(*keys, F.col("k").cast("long").alias("k"), "left", "right")


def acf(returns: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """keys, lag, acf with the biased denominator; zero for a flat series."""
    d = returns.withColumn("d", F.col("r") - F.avg("r").over(Window.partitionBy(*keys)))
    w = ordered(keys)
    d = d.select(*keys, "d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in lags])
    sums = d.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("all"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"s{k}").alias("s")) for k in lags])).alias("x")
    return sums.select(*keys, "all", each).select(*keys, "x.lag", F.when(F.col("all") > 0, F.coalesce(F.col("x.s"), F.lit(0.0)) / F.col("all")).otherwise(0.0).alias("acf"))


def intermittency(returns: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """keys, lambda2, integral_scale: fit of Cov(ln|r|) at lags 1..max_lag on -ln lag; zeros count as the least nonzero |r|."""
    all_ = Window.partitionBy(*keys)
    least = F.min(F.when(F.col("r") != 0, F.abs("r"))).over(all_)
    y = returns.withColumn("y", F.ln(F.when(F.col("r") != 0, F.abs("r")).otherwise(least)))
    d = y.withColumn("d", F.col("y") - F.avg("y").over(all_))
    lags = range(1, max_lag + 1)
    d = d.select(*keys, "d", *[F.lag("d", k).over(ordered(keys)).alias(f"d{k}") for k in lags])
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col("d") * F.col(f"d{k}")).alias(f"d{k}") for k in lags])
    cov = sums.select(*keys, "n", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"d{k}").alias("cov")) for k in lags])))
    x = -F.ln("lag")
    fit = cov.groupBy(*keys, "n").agg(F.regr_slope("cov", x).alias("lambda2"), F.regr_intercept("cov", x).alias("at"))
    scale = F.least(F.greatest(F.exp(F.least(F.col("at") / F.col("lambda2"), F.lit(700.0))), F.lit(float(max_lag))), 10.0 * F.col("n"))
    return fit.select(*keys, "lambda2", F.when(F.col("lambda2") > 0, scale).alias("integral_scale"))


#: Sizes of boxes: the least, and how many there are up to a quarter of the series.
LEAST_BOX, BOX_POINTS = 16, 12


def scales(n: int, points: int = BOX_POINTS) -> list[int]:
    """Box sizes from 16 to a quarter of the series, evenly spaced in the logarithm."""
    return sorted({round(LEAST_BOX * (n // 4 / LEAST_BOX) ** (k / (points - 1))) for k in range(points)})


def box_sizes(n: Column, points: int = BOX_POINTS) -> Column:
    """scales() of a column of lengths."""
    most = F.greatest(F.floor(n / 4), F.lit(1)) / LEAST_BOX
    return F.array_distinct(F.array(*[F.bround(LEAST_BOX * F.pow(most, F.lit(k / (points - 1)))).cast("int") for k in range(points)]))


def fluctuations(series: DataFrame, keys: list[str], sizes: Column | None = None) -> DataFrame:
    """keys, hurst of series (keys, i from 0, n, x): detrended fluctuation analysis with straight lines, boxes laid from both ends.

    Sums of the profile y, of i y and of y^2 run along the series. The line of a box, and what it leaves, follow from their
    differences over it, so only rows at the boxes' ends go on: some 2 n / size for each size, not 2 n.
    """
    n = F.col("n").cast("int")
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = series.withColumn("y", F.sum(F.col("x") - F.avg("x").over(Window.partitionBy(*keys))).over(w))
    i = F.col("i").cast("double")
    p = p.select(*keys, (F.col("i") + 1).cast("int").alias("e"), n.alias("n"), F.sum("y").over(w).alias("s0"), F.sum(i * F.col("y")).over(w).alias("s1"), F.sum(F.col("y") * F.col("y")).over(w).alias("s2"))
    sizes = box_sizes(F.col("n")) if sizes is None else sizes
    p = p.where(F.col("n") >= 4 * LEAST_BOX).select("*", F.explode(sizes).alias("size"))
    into = F.col("e") % F.col("size")
    offs = F.array(F.when(into == 0, F.struct(F.lit(0).alias("end"), F.lit(0).alias("off"))), F.when(into == F.col("n") % F.col("size"), F.struct(F.lit(1).alias("end"), into.alias("off"))))
    p = p.where((into == 0) | (into == F.col("n") % F.col("size"))).select(*keys, "n", "size", "e", "s0", "s1", "s2", F.inline(F.array_compact(offs)))
    p = p.select(*keys, "n", "end", "size", "off", "s0", "s1", "s2", ((F.col("e") - F.col("off")) / F.col("size")).cast("int").alias("k"))
    # a row ends box k - 1 and begins box k
    sides = F.array(F.struct((F.col("k") - 1).alias("box"), F.lit(1.0).alias("sign")), F.struct(F.col("k").alias("box"), F.lit(-1.0).alias("sign")))
    boxes = p.select(*keys, "n", "end", "size", "off", "s0", "s1", "s2", F.inline(sides)).where((F.col("box") >= 0) & ((F.col("box") + 1) * F.col("size") + F.col("off") <= F.col("n")))
    sums = boxes.groupBy(*keys, "end", "size", "off", "box").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("s0", "s1", "s2")])
    size = F.col("size").cast("double")
    middle = F.col("off") + F.col("box") * size + (size - 1) / 2
    sxy = F.col("s1") - middle * F.col("s0")
    rss = F.col("s2") - F.col("s0") * F.col("s0") / size - sxy * sxy / (size * (size * size - 1) / 12)
    f = sums.groupBy(*keys, "size").agg(F.sqrt(F.greatest(F.sum(rss), F.lit(0.0)) / F.sum(size)).alias("f"))
    return f.groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln("size")).alias("hurst"))


def dfa(returns: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys, hurst of returns (keys, date, r) over boxes of these sizes."""
    p = numbered(returns, keys).select(*keys, "i", "n", F.col("r").alias("x"))
    return fluctuations(p, keys, F.array(*map(F.lit, sizes)))


def patterns(series: DataFrame, keys: list[str], order: int = 4) -> DataFrame:
    """keys, entropy of series (keys, i, x): of the ordinal patterns of `order` neighbours, over ln(order!); equal values rank by position."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = series.select(*keys, *[F.lead("x", k).over(w).alias(f"v{k}") for k in range(order)]).where(F.col(f"v{order - 1}").isNotNull())
    later = [(F.col(f"v{a}") > F.col(f"v{b}")).cast("int") * (1 << k) for k, (a, b) in enumerate((a, b) for b in range(order) for a in range(b))]
    counts = rows.groupBy(*keys, sum(later[1:], later[0]).alias("pattern")).agg(F.count("*").alias("c"))
    # -sum(p ln p) with p = c / n, from sums over the patterns
    sums = counts.groupBy(*keys).agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.ln("c")).alias("own"))
    return sums.select(*keys, ((F.ln("all") - F.col("own") / F.col("all")) / math.log(math.factorial(order))).alias("entropy"))


def permutation_entropy(returns: DataFrame, keys: list[str], order: int = 4) -> DataFrame:
    """keys, entropy of returns (keys, date, r): see patterns()."""
    return patterns(returns.select(*keys, F.col("date").alias("i"), F.col("r").alias("x")), keys, order)


def garch_variance(returns: DataFrame, keys: list[str], omega: float, alpha: float, beta: float) -> DataFrame:
    """keys, date, variance: omega + alpha e^2 + beta variance of the step before, from the series' mean square v0.

    Linear in the rows: the variance is a sum of earlier terms that decay by beta a step. In a block of rows it is a running sum
    of terms over beta^step, scaled back. Blocks are so long that what lies before the last one decays below the smallest double.
    """
    if not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    block = max(2, int(600 / -math.log(beta)))
    rows = numbered(returns, keys).select(*keys, "date", "i", (F.col("r") * F.col("r")).alias("e2"), F.avg(F.col("r") * F.col("r")).over(Window.partitionBy(*keys)).alias("v0"))
    rows = rows.withColumns({"block": F.floor(F.col("i") / block), "step": (F.col("i") % block).cast("double")})
    b = F.lit(float(beta))
    own = Window.partitionBy(*keys, "block").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    term = F.lit(omega) + F.lit(alpha) * F.col("e2")
    # up to and with this row: the variance of the next one, without what came into the block
    rows = rows.withColumn("after", F.sum(term * F.pow(b, -F.col("step") - 1)).over(own) * F.pow(b, F.col("step") + 1))
    before = F.lag("after", 1, 0.0).over(Window.partitionBy(*keys, "block").orderBy("step"))
    ends = rows.groupBy(*keys, (F.col("block") + 1).alias("block")).agg(F.max_by("after", "step").alias("carried"), F.max("step").alias("last"))
    x = rows.withColumn("inside", before).join(ends, [*keys, "block"], "left")
    start = F.when(F.col("block") == 0, F.col("v0")).when(F.col("block") == 1, F.col("carried") + F.pow(b, F.col("last") + 1) * F.col("v0")).otherwise(F.col("carried"))
    return x.select(*keys, "date", (F.col("inside") + F.pow(b, F.col("step")) * start).alias("variance"))
