"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores. Every query runs twice into the no-op sink; the second
run is reported, the first under `cold`.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans import registry
from tickloom.session import build_session

HEADLINE = [
    "candles_hourly", "pair_spread_features", "flow_hourly_pivot", "volume_zscores", "bollinger_z", "rolling_moments",
    "ema_trend", "targets", "feature_matrix", "feature_audit", "window_dataset", "flat_windows",
    "token_live", "gainers", "liquidity_risk", "radar", "trend_top20", "alert_rules", "rising_edges", "token_hourly",
    "token_merge", "token_enrich", "portfolio_metrics", "portfolio_metrics_ordinal", "momentum_alpha_signal",
    "sentiment_by_conversation", "whale_transfers", "summary_cards", "parse_klines", "parse_agg_trades", "upsert_candles",
    "get_or_create", "prediction_decode", "loss_metrics", "stream_hourly_flow", "stream_rising_edges",
]


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tickloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in names:
        cold[name] = run(queries[name], spark, sf_dir)
        warm[name] = run(queries[name], spark, sf_dir)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
