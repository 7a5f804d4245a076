"""Times the headline queries once each, after one warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from tapeworks.plans import registry  # noqa: E402
from tapeworks.session import local_session  # noqa: E402

HEADLINE = ["candles_bars", "signals", "simulate", "mtm_equity", "backtest_summary", "trade_stats", "kelly_grid", "asof_match", "reconcile", "order_rollup", "bootstrap_lcg", "monthly_returns", "dfa_hurst", "feed_compare", "redact", "forward_performance", "signal_fidelity", "kelly_report", "decision_rule", "channel_variants", "drawdown_locks", "desk_report", "order_checks", "stylized_facts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    known = registry.queries()
    known["candles_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        if name in known:
            began = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
