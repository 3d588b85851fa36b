"""Compare registered queries with their SQL: python -m tests.check [sf_dir] [name part ...]."""

import sys
import time
import traceback

from __spark_entry__ import oracle_sql, queries
from tests.conftest import session
from tests.oracle import compare, connect


def main(sf_dir="/root/testdata/sf0.01", *parts):
    spark, con, sqls, bad = session(), connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                n = ""
            else:
                diff, n = None, f"rows={df.count()}"
        except Exception:
            diff = traceback.format_exc(limit=-2)[-2500:]
            n = ""
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.2f}s "
              f"{'' if name in sqls else 'no-sql '}{n}{diff[:2500] if diff else ''}", flush=True)
        if diff:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
