"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

``python bench.py --scales`` instead times the three reports end to end, from text or
Parquet to written report, on flight sets as large as the published timings used.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tarmac.checks.registry import QUERIES  # noqa: E402
from tarmac.plans import carrier_deviation, delay_band_report, route_month_stats  # noqa: E402
from tarmac.schema import (  # noqa: E402
    CARRIER_DEVIATION_KEY,
    DELAY_BAND_KEY,
    FLIGHT_COLUMNS,
    ROUTE_MONTH_KEY,
)
from tarmac.session import build_session  # noqa: E402
from tarmac.sources import read_csv, read_parquet, write_report  # noqa: E402
from tarmac.sources.tables import flights_view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "route_month_stats",
    "delay_band_report",
    "carrier_deviation",
    "cause_top3",
    "airport_means",
    "clean_flights",
    "clean_audit",
    "null_counts",
    "sample_25",
    "oversample_150",
    "scaled_counts",
    "reconcile_precision",
    "set_difference",
    "run_pivot",
    "run_break_even",
    "run_extremes",
    "sample_strata_25",
    "csv_rejects",
]
RUNS = 3


def session():
    spark = build_session(
        "bench",
        spark__master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def run_queries(spark) -> dict[str, float]:
    """Median seconds per query over several rounds, the first round being warm-up.

    Every result row is computed.
    """
    rounds: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for _ in range(1 + RUNS):
        for name, seconds in rounds.items():
            result = QUERIES[name]
            seconds.append(
                timed(
                    lambda: result(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                )
            )
    return {name: round(sorted(s[1:])[RUNS // 2], 3) for name, s in rounds.items()}


# Copies of the sf0.1 flights (600,000 rows) that come closest to each published scale.
COPIES = {10: 1, 25: 3, 50: 6, 75: 9, 100: 12, 150: 18}


def run_scales(spark) -> dict:
    work = tempfile.mkdtemp(prefix="bench-scales-")
    flights = flights_view(spark, SF_DIR).withColumn(
        "fl_date", F.col("fl_date").cast("timestamp")
    )
    reports = {
        "3.1": (route_month_stats, ROUTE_MONTH_KEY),
        "3.2": (delay_band_report, DELAY_BAND_KEY),
        "3.3": (carrier_deviation, CARRIER_DEVIATION_KEY),
    }
    result: dict = {}
    for pct, copies in COPIES.items():
        repeated = flights.withColumn(
            "_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))
        ).select(*FLIGHT_COLUMNS)
        repeated.repartition(8).write.parquet(f"{work}/{pct}/parquet")
        stored = spark.read.parquet(f"{work}/{pct}/parquet")
        stored.write.option("header", True).csv(f"{work}/{pct}/csv")
        for fmt, read in (("csv", read_csv), ("parquet", read_parquet)):
            for name, (report, order) in reports.items():
                seconds = timed(
                    lambda: write_report(
                        report(read(spark, f"{work}/{pct}/{fmt}").good),
                        f"{work}/{pct}/out-{fmt}-{name}",
                        order,
                    )
                )
                result.setdefault(f"{name} {fmt}", {})[f"{pct}%"] = round(seconds, 2)
    return result


def main() -> None:
    spark = session()
    if "--scales" in sys.argv:
        print(json.dumps({"metric": "report_seconds", "unit": "sec", "runs": run_scales(spark)}))
        return
    seconds = run_queries(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
