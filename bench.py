"""Time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line.

The panel uses one symbol per brand and type (150 symbols), so that symbols are many.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.queries import load_registry
from tidemark.session import build_session
from tidemark.sources.adapters import Domain

HEADLINE = ["A4_risk_table", "A5_correlation_matrix", "W2_period_returns", "T1_forward_fill", "T5_wilder_rsi", "T7_indicator_snapshot",
            "T9_weekly_signal", "B1_drawdown_episodes", "T10_trend_channel", "C18_screener", "A9_holdings", "A10_portfolio_totals",
            "W17_running_average_cost", "W18_trade_number_in_month", "J1_buys_to_benchmark", "B16_shadow_benchmark", "B19_reinvested_dividends",
            "B17_xirr", "C8_rebalance_plan", "A14_category_anomalies", "C20_goal_progress", "B11_strategy_signals",
            "B12_signal_backtest", "B14_walk_forward", "A15_sentiment_rollup"]
# these name their symbols one by one, so they run on the six types
BY_TYPE = ["C5_budget_allocation", "B3_backtest_metrics", "B8_ab_metrics", "B10_edge_lab", "B13_parameter_search"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    wide, narrow = Domain(spark, folder, by_brand=True), Domain(spark, folder)
    registry["A4_risk_table"].run_on(narrow).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE + BY_TYPE:
        start = time.perf_counter()
        registry[name].run_on(narrow if name in BY_TYPE else wide).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(os.path.normpath(folder))}))
    spark.stop()


if __name__ == "__main__":
    main()
