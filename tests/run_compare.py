"""Command line: compare all (or the named) queries at one scale. `python tests/run_compare.py 0.01 [name...]`"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pulseline.session import build_session  # noqa: E402


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                note = "sql"
            else:
                diff, note = [], f"rows={len(df.collect())}"
        except Exception as exc:  # noqa: BLE001
            diff, note = [f"{type(exc).__name__}: {str(exc)[:700]}"], "error"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
        for line in diff:
            print("   ", line, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
