"""Documents that hold aligned arrays: checked inside the record, bound to each other by digests, then put to use.

A check names the first reason why a document is refused; nothing of a refused one goes into a report. Arrays are checked with
array functions, so a document never leaves its row until it is accepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import underwater

#: Bounds of days and trades in a document, and of its numbers.
MOST_DAYS = 20_000
VALUE, PERCENT, RETURN, BOUND = (0.000001, 1e15), (0.0, 100.0), (-100.0, 1e9), (-1e12, 1e12)


def bounded(x: Column, low: float, high: float) -> Column:
    """Whether x is a finite number within bounds; null is none."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (x >= low) & (x <= high), F.lit(False))


def every(xs: Column, low: float, high: float) -> Column:
    """Whether all elements are bounded(); a null array has none that is."""
    return F.coalesce(F.forall(xs, lambda x: bounded(x, low, high)), F.lit(False))


def _first(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails; a check that is null fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in checks])


def run_errors(runs: DataFrame) -> DataFrame:
    """runs (start, end, dates as ISO text; strategy, buy_hold, drawdowns, hold_return_pct; trades: an array of percent returns)
    with `refused`, the first reason, null if there is none."""
    days = F.transform("dates", lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))
    start, end = (F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in ("start", "end"))
    n = F.size("dates")
    pairs = F.zip_with(F.slice(F.col("__days"), F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(F.col("__days"), F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.coalesce(F.datediff(b, a) == 1, F.lit(False)))
    x = runs.withColumn("__days", days)
    refused = _first(
        (F.datediff(end, start).between(1, MOST_DAYS), "period"),
        (n.between(1, MOST_DAYS), "number of days"),
        ((F.get("__days", F.lit(0)) >= start) & (F.get("__days", n - 1) == F.date_sub(end, 1)), "days outside the period"),
        (F.forall(pairs, lambda ok: ok), "days not consecutive"),
        ((F.size("strategy") == n) & (F.size("buy_hold") == n), "series not aligned"),
        (every(F.col("strategy"), *VALUE) & every(F.col("buy_hold"), *VALUE), "value out of bounds"),
        (bounded(F.col("max_drawdown_pct"), *PERCENT) & bounded(F.col("hold_drawdown_pct"), *PERCENT), "drawdown out of bounds"),
        (bounded(F.col("hold_return_pct"), *RETURN), "return out of bounds"),
        (F.size("trades").between(0, MOST_DAYS), "number of trades"),
        (every(F.col("trades"), *RETURN), "trade out of bounds"),
    )
    return x.withColumn("refused", refused).drop("__days")


def evidence_errors(stats: DataFrame) -> DataFrame:
    """stats (mean_ci, sharpe_ci, timing) with `refused` and whether each interval includes zero."""
    def interval(c: str) -> list[tuple[Column, str]]:
        return [(F.size(c) == 2, f"{c}: not two bounds"), (every(F.col(c), *BOUND), f"{c}: not finite"), (F.get(c, F.lit(0)) <= F.get(c, F.lit(1)), f"{c}: reversed")]

    refused = _first(*interval("mean_ci"), *interval("sharpe_ci"), (bounded(F.col("timing"), 0.0, 1.0), "timing out of bounds"))
    zero = [((F.get(c, F.lit(0)) <= 0) & (F.get(c, F.lit(1)) >= 0)).alias(f"{c}_includes_zero") for c in ("mean_ci", "sharpe_ci")]
    return stats.select("*", refused.alias("refused"), *zero)


def bound_documents(curves: DataFrame, stats: DataFrame, physics: DataFrame) -> DataFrame:
    """curves (name, sha256, ...), stats (name, source_sha256, ...) and physics (name, source_sha256, growth; may be missing) of one
    name in one row, with `refused`: why they don't belong together, or the curves' or the statistics' own reason."""
    c = run_errors(curves).withColumnRenamed("refused", "run_refused")
    s = evidence_errors(stats).withColumnsRenamed({"refused": "stats_refused", "source_sha256": "stats_source"})
    p = physics.select("name", F.lit(True).alias("has_physics"), F.col("source_sha256").alias("physics_source"), "growth")
    x = c.join(s, "name", "full_outer").join(p, "name", "left")
    fits = _first(
        (F.col("sha256").isNotNull() & F.col("stats_source").isNotNull(), "sets of runs differ"),
        (F.col("stats_source") == F.col("sha256"), "statistics of other curves"),
        (F.col("has_physics").isNull() | (F.col("physics_source") == F.col("sha256")), "physics of other curves"),
        (F.col("has_physics").isNull() | F.col("growth").isNotNull(), "no growth"),
    )
    return x.withColumn("refused", F.coalesce(fits, F.col("run_refused"), F.col("stats_refused"))).drop("run_refused", "stats_refused", "has_physics")


def desk_report(documents: DataFrame, initial: float) -> DataFrame:
    """One row a document of bound_documents(): refused, or what its daily values and trades show.

    Risk counts from the initial value at the period's start; the two best trades are those above zero.
    """
    ok = documents.where("refused is null")
    # arrays go apart only now, and each document's days meet again by name
    values = ok.select("name", F.to_date("start").alias("start"), F.inline(F.arrays_zip("dates", "strategy", "buy_hold"))).withColumn("date", F.to_date("dates"))
    sides = []
    for c, out in (("strategy", "strategy"), ("buy_hold", "hold")):
        u = underwater(values, ["name"], c, initial, "start")
        sides.append(u.select("name", *[F.col(k).alias(f"{out}_{k}") for k in ("return_pct", "max_drawdown_pct", "longest_underwater_days")]))
    best = F.slice(F.filter(F.sort_array("trades", asc=False), lambda x: x > 0), 1, 2)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    own = documents.select("name", "refused", F.size("dates").cast("long").alias("days"), total(best).alias("top_two_pp"), (total(F.col("trades")) - total(best)).alias("rest_pp"), "mean_ci_includes_zero", "sharpe_ci_includes_zero", "timing", "growth")
    x = reduce(lambda a, b: a.join(b, "name", "left"), sides, own)
    return x.select("name", "refused", *[F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in x.columns if c not in ("name", "refused")])
