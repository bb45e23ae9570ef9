"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "ohlcv_bars", "sma", "rsi", "bollinger", "macd", "kama", "supertrend", "market_conditions", "asof_price", "protocol_metrics",
    "token_metrics", "protocol_correlation", "asset_allocation", "vault_balance", "vote_tally_yes_no", "portfolio_analytics",
    "value_at_risk", "regression_metrics", "trading_metrics", "calibration_metrics", "social_metrics", "dominant_themes",
    "sentiment_trends", "outliers_iqr", "scale_robust", "sequences", "select_mutual_information", "trade_risk", "signal_log_index",
]


def main() -> None:
    from tidelens.plans.catalog import catalogue
    from tidelens.session import local_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    cat = catalogue()
    cat["ohlcv_bars"].run(spark, root).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        cat[name].run(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": root.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
