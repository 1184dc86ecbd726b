"""Seconds per headline query on the sample tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from khata.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "s12_events", "p1_postings", "j1_links", "a1_balances", "a4_variance_weekly", "a5_movement_slices", "a8_fees_by_method",
    "c18_findings", "j13_coverage", "a21_close_summary", "c21_restatement", "a20_weeks", "n2_payouts_without_credit",
    "q1_unbalanced_entries", "u2_distinct_facts", "w5_sequence", "w1_statement_report", "c26_tax_risks", "x1_forecast_days",
    "w7_split_floors", "x6_rediscover", "x8_grounding_rate", "x15_fee_audit", "p12_instruction_shapes", "f4_apportion",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="khata-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        began = time.time()
        # every row is computed in full and thrown away
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
