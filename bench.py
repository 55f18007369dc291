"""Wall time of the headline jobs. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2
timed runs after one warm-up; the median counts). Source tables derived from the driver's
tables are written before the clock starts; every job reads them from storage.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import adapters as A  # noqa: E402
from plotscope.operators.flips import flip_backtest  # noqa: E402
from plotscope.operators.parcels import build_parcels, zip_summary  # noqa: E402
from plotscope.operators.sales import dedup_report, sale_history, typed_sales  # noqa: E402
from plotscope.operators.stability import id_transitions  # noqa: E402
from plotscope.plans.backtest import run_backtest, valued_subjects  # noqa: E402
from plotscope.plans.leakage import accuracy_before_after  # noqa: E402
from plotscope.plans.screen import screen  # noqa: E402


def jobs(spark: SparkSession, d: str):
    raw, roll, stability = A.raw_sales(spark, d), A.raw_county_roll(spark, d), A.stability_rolls(spark, d)
    sales, snaps, parcels = A.history(spark, d), A.snapshots(spark, d), A.parcels(spark, d)
    return {
        "sale_history": lambda: sale_history(raw),
        "dedup_report": lambda: dedup_report(typed_sales(raw)),
        "parcel_table": lambda: build_parcels(roll, assessment_year=A.ASSESSMENT_YEAR),
        "zip_summary": lambda: zip_summary(parcels),
        "id_transitions": lambda: id_transitions(stability),
        "valuation_one_date": lambda: valued_subjects(sales, snaps, A.AS_OF_DATES[:1]),
        "valuation_two_dates": lambda: valued_subjects(sales, snaps, A.AS_OF_DATES),
        "screen": lambda: screen(parcels, sales, snaps, A.SCREEN_DATE),
        "backtest": lambda: run_backtest(sales, snaps, A.AS_OF_DATES),
        "accuracy": lambda: accuracy_before_after(sales, snaps, A.AS_OF_DATES),
        "flip_backtest": lambda: flip_backtest(parcels),
    }


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plotscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, job in jobs(spark, d).items():
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    result = {
        "metric": "total wall time of headline jobs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
