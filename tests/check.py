"""python tests/check.py [sf dir] [name part ...]: every query against its SQL, with times."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import duck, spark_rows  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = local_session(cores=8)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        cols, rows = spark_rows(fn(spark, sf))
        took = time.time() - start
        if name not in sqls:
            print(f"rows  {name} {len(rows)} {took:.1f}s")
            continue
        start = time.time()
        c2, r2 = duck(sf, sqls[name])
        duck_took = time.time() - start
    except Exception as exc:  # noqa: BLE001
        bad += 1
        print(f"ERROR {name}: {str(exc)[:700]}")
        continue
    same = cols == c2 and rows == r2
    print(f"{'ok   ' if same else 'DIFF '} {name} {len(rows)}/{len(r2)} {took:.1f}s duck {duck_took:.1f}s")
    if not same:
        bad += 1
        print("   ", cols, c2)
        diff = [(a, b) for a, b in zip(rows, r2) if a != b][:2]
        for a, b in diff:
            print("    spark", str(a)[:600])
            print("    duck ", str(b)[:600])
print("bad:", bad)
