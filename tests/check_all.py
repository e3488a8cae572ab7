"""Compare every registered query with its SQL: ``check_all.py SF_DIR [name part ...]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf, parts):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    oracles = entry.oracle_sql()
    con = connect(sf)
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                found = differences(df, oracles[name], con)
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(found)
        mark = "FAIL" if found else ("ok" if name in oracles else "rows")
        print(f"{mark:5} {name:40} {time.time() - started:6.2f}s", *found, flush=True)
    print(f"{bad} failing")


main(sys.argv[1], sys.argv[2:])
