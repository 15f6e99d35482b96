"""Run every registered query against its oracle: python tests/check_all.py [sf_dir] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

from countwatch.plans.registry import ORACLES, QUERIES  # noqa: E402
from countwatch.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        t, sql = time.time(), ORACLES.get(name)
        try:
            df = QUERIES[name](spark, sf)
            sql = ORACLES.get(name)
            if sql:
                why = difference(df, con, sql)
            else:
                why = None if df.count() >= 0 else "no rows"
        except Exception as exc:  # report every query, not just the first broken one
            why = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {time.time() - t:6.1f}s {name}{'' if sql else ' (no oracle)'} {why or ''}", flush=True)
    print("failed:", failed)
    spark.stop()
