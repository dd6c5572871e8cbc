"""Run every query against its SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from dialogmill.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sql = spark_entry.oracle_sql()
    bad = 0
    for name, fn in spark_entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            n = oracle.compare(spark, sf_dir, name, fn, sql[name]) if name in sql else fn(spark, sf_dir).count()
            print(f"ok   {name:30s} {n:8d} rows {time.time() - start:6.2f}s", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name:30s} {type(error).__name__}: {str(error)[:900]}", flush=True)
            if wanted:
                traceback.print_exc()
    sys.exit(1 if bad else 0)
