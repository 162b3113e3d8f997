"""Headline benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the local cores.
Each query is run once to warm up and then timed; the time covers planning and a full materialisation.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("daily_breadth", "rolling_intelligence", "indicator_suite", "symbol_indicators", "feature_set", "all_signals",
            "all_anomalies", "spearman_matrix", "mutual_information", "frequent_movers", "forecast_metrics",
            "headline_sentiment", "gap_fill", "dq_bars")


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from tickloom.plans.catalogue import QUERIES
    from tickloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark = local_session(app="bench")
    times = {}
    for name in names:
        run(spark, QUERIES[name], sf_dir)
        times[name] = round(run(spark, QUERIES[name], sf_dir), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
