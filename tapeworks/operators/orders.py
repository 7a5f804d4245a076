"""Orders of a trade (1:n) against the trade: how many fills there may be, and whether quantities agree within the exchange's precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of an order that is over, sides that end a trade, and the modes of a precision.
TERMINAL, EXITS = ["closed", "canceled", "cancelled", "expired", "rejected"], ["sell", "stoploss"]
DECIMALS, SIGNIFICANT, TICK = 2, 3, 4
#: Reasons to refuse a trade, in the order they are looked for.
REASONS = ["nonterminal order", "several fills", "no precision", "invalid precision", "no net quantity", "entry quantity", "exit quantity"]
UNFILLED = "unfilled"


def unit_of(amount: Column, digits: Column, mode: Column) -> Column:
    """The least step of an amount: a number of decimals, of significant digits, or a tick."""
    ten = F.lit(10.0)
    return F.when(mode == TICK, digits).when(mode == DECIMALS, F.pow(ten, -F.floor(digits))).when(mode == SIGNIFICANT, F.pow(ten, F.floor(F.log10(amount)) - F.floor(digits) + 1))


def near(a: Column, b: Column, unit: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-10 * F.greatest(F.abs(a), F.abs(b)), unit * 1.000001)


def checked_fills(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """trade_id, reason (null: accepted; UNFILLED: an open trade without a fill), and when the trade was submitted, opened, its
    exit submitted, and closed by its orders.

    trades: trade_id, is_open, amount, open_date, digits, mode. orders: trade_id, side, status, is_open, filled, fee_base,
    order_date, filled_date. One aggregate a trade over its orders with a fill; trades without orders count as without fills.
    """
    filled = orders.where(F.coalesce("filled", F.lit(0.0)) > 0)
    bad = F.col("is_open") | F.col("filled_date").isNull() | ~F.coalesce(F.col("status").isin(TERMINAL), F.lit(False))
    entry, exit_ = F.col("side") == "buy", F.col("side").isin(EXITS)

    def only(flag: Column, c: str) -> Column:
        return F.max(F.when(flag, F.col(c)))

    own = filled.groupBy("trade_id").agg(
        F.count_if(F.coalesce(bad, F.lit(True))).alias("nonterminal"), F.count("*").alias("fills"), F.count_if(entry).alias("entries"), F.count_if(exit_).alias("exits"),
        only(entry, "filled").alias("bought"), only(entry, "fee_base").alias("fee_base"), only(exit_, "filled").alias("sold"), only(entry, "filled_date").alias("entered"), only(exit_, "order_date").alias("exit_submitted"), only(exit_, "filled_date").alias("exited"),
    )
    x = trades.join(own, "trade_id", "left").fillna(0, ["nonterminal", "fills", "entries", "exits"])
    x = x.withColumn("expected", F.col("bought") - F.coalesce("fee_base", F.lit(0.0)))
    digits, mode, amount = F.col("digits"), F.col("mode"), F.col("amount")
    unit = unit_of(F.col("expected"), digits, mode)
    closed = F.when(F.col("is_open"), 0).otherwise(1)
    known = digits.isNotNull() & F.coalesce(mode.isin(DECIMALS, SIGNIFICANT, TICK), F.lit(False))
    finite = ~F.isnan(digits) & (digits < float("inf")) & (digits >= 0) & ~((mode == TICK) & (digits == 0))
    checks = [
        F.col("nonterminal") > 0,
        (F.col("entries") != 1) | (F.col("exits") != closed) | (F.col("fills") != F.col("entries") + F.col("exits")),
        ~known, ~finite, F.col("expected") <= 0, ~near(amount, F.col("expected"), unit), (F.col("exits") > 0) & ~near(F.col("sold"), amount, unit),
    ]
    unfilled = (F.col("nonterminal") == 0) & (F.col("entries") == 0) & (F.col("exits") == 0) & F.col("is_open")
    first = F.coalesce(*[F.when(c, r) for c, r in zip(checks, REASONS, strict=True)])
    x = x.withColumn("reason", F.when(unfilled, UNFILLED).otherwise(first))
    ok = F.col("reason").isNull()
    return x.select("trade_id", "reason", *[F.when(ok, F.col(c)).alias(n) for c, n in (("open_date", "submitted_date"), ("entered", "open_date"), ("exit_submitted", "exit_submitted_date"), ("exited", "close_date"))])
