"""Compare catalog queries with their DuckDB oracle: python tools/oracle_check.py [sf_dir] [names...]"""
import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))

from compsight.plans.catalog import ORACLE, QUERIES  # noqa: E402
from compsight.session import build_session  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = build_session("local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf_dir)
bad = 0
for n in names:
    t = time.time()
    try:
        if n in ORACLE:
            r = compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
        else:
            cnt = QUERIES[n](spark, sf_dir).count()
            r = {"name": n, "ok": True, "rows_only": cnt}
    except Exception as e:  # noqa: BLE001
        r = {"name": n, "ok": False, "detail": traceback.format_exc()[-1500:]}
    r["sec"] = round(time.time() - t, 2)
    bad += not r["ok"]
    detail = r.pop("detail", None)
    print(json.dumps(r))
    if detail:
        print(detail)
print("FAILED", bad, "of", len(names))
