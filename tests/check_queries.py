"""Run registered queries against DuckDB: python tests/check_queries.py [sf] [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidyloom import get_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = get_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g", spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, d)
            if name in sqls:
                result = compare(df, con, sqls[name]) or "ok"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as error:
            result = f"ERROR {str(error)[:600]}"
            if "--trace" in sys.argv:
                traceback.print_exc()
        bad += not (result == "ok" or result.startswith("rows only"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {result}", flush=True)
    print("failures:", bad)
