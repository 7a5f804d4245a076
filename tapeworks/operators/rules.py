"""Decision rules, order feasibility, and text rules of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a log line must not show, and what stands for it.
SECRETS = [(r"(?i)(bearer|token)\s+[A-Za-z0-9._-]+", "$1 ***"), (r"[\w.+-]+@[\w-]+\.[\w.]+", "***"), (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "***"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "***")]


def decision(runs: DataFrame, limit: float = 0.6) -> DataFrame:
    """run, criterion, margin, passes, verdict, binding: four rules on a run's net return, drawdown against holding, and costs.

    runs: run, net_pct, stress_pct, validation_pct, drawdown_pct, hold_drawdown_pct.
    """
    margins = [("K1", F.col("net_pct")), ("K2", limit * F.col("hold_drawdown_pct") - F.col("drawdown_pct")), ("K3", F.col("stress_pct")), ("K4", F.col("validation_pct"))]
    rows = F.array(*[F.struct(F.round(m, 4).alias("margin"), F.lit(k).alias("criterion"), (m >= 0 if k == "K2" else m > 0).alias("passes")) for k, m in margins])
    r = runs.select("run", rows.alias("rows"))
    verdict = F.when(F.forall("rows", lambda x: x["passes"]), "GO").otherwise("NO-GO")
    r = r.select("run", verdict.alias("verdict"), F.array_min("rows")["criterion"].alias("binding"), F.explode("rows").alias("x"))
    return r.select("run", "x.criterion", "x.margin", "x.passes", "verdict", "binding")


def feasibility(orders: DataFrame, tick: float, fee: float, amount_min: float, cost_min: float, stoploss: float) -> DataFrame:
    """orders (order_id, stake, price) with amounts rounded down to the tick, dust, stop value and the reasons against each."""

    def down(x: Column) -> Column:
        return F.floor(x / tick + 1e-9) * tick

    o = orders.withColumn("amount", down(F.col("stake") / F.col("price")))
    o = o.withColumns({"cost": F.col("amount") * F.col("price"), "sellable": down(F.col("amount") * (1 - fee))})
    o = o.withColumns({"dust": F.col("stake") - F.col("cost"), "stop_value": F.col("sellable") * F.col("price") * (1 + stoploss)})
    reasons = [
        F.when(F.col("amount") <= 0, "entry rounds to zero").when(F.col("amount") < amount_min, "entry below minimum amount"),
        F.when(F.col("cost") < cost_min, "entry below minimum cost"),
        F.when(F.col("sellable") < amount_min, "exit below minimum amount"),
        F.when(F.col("stop_value") < cost_min, "stop below minimum cost"),
    ]
    return o.withColumn("reasons", F.concat_ws("; ", F.array_compact(F.array(*reasons)))).withColumn("feasible", F.col("reasons") == "")


def candidate_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def redacted(text: Column) -> Column:
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text
