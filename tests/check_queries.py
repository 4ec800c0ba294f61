"""Run registered queries against their SQL: ``python tests/check_queries.py [sf_dir] [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, difference
from wideloom.session import local_session

if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if wanted and name not in wanted and fn.__module__.rsplit("_", 1)[-1] not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = difference(df, con, oracles[name]) if name in oracles else (None if df.count() >= 0 else "no rows")
        except Exception as e:
            problem = "".join(traceback.format_exception_only(e))[:1500]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} failed")
