"""Run registered queries against their SQL: python tests/run_checks.py FOLDER [name-part ...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    folder, parts = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="khata-checks-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(folder), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            frame = run(spark, folder)
            if name in sql:
                said = differences(frame, con, sql[name])
            else:
                said = ""
                print(f"  ({name}: {len(frame.collect())} rows, no SQL)")
        except Exception as exc:  # noqa: BLE001
            said = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(said)
        print(f"{'ok  ' if not said else 'FAIL'} {name} {time.time() - began:.1f}s {said}", flush=True)
    print("failed:", bad)
