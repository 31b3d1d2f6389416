"""Command line: compare all queries (or the named ones) at one scale."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import difference, sql_result, type_differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main(folder, names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle_sql()
    for name, function in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = function(spark, folder)
            found = result.toPandas()
            took = time.time() - start
            start = time.time()
            said = f"no SQL, {len(found)} rows"
            if name in sql:
                expected, types = sql_result(folder, sql[name])
                said = difference(found, expected) or type_differences(result.dtypes, types) or None
            print(f"{name:26} {took:6.2f}s {time.time() - start:6.2f}s {len(found):7d} rows  {said or 'same'}", flush=True)
        except Exception as error:
            print(f"{name:26} FAILED {type(error).__name__}: {str(error)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
