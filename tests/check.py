"""``python tests/check.py [pattern ...]``: compare registered queries, one line each."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from namesmith.session import local_session  # noqa: E402
from tests.compare import difference, duck  # noqa: E402


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    patterns = []
    for a in argv:
        if a.startswith("sf"):
            sf = f"/root/testdata/{a}"
        else:
            patterns.append(a)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        t0 = time.time()
        try:
            if name in sql:
                df = fn(spark, sf)
                problem = difference(df, con, sql[name])
                kinds = {f.dataType.typeName() for f in df.schema.fields} & {"array", "map", "struct"}
                problem = problem or (f"nested columns {kinds}" if kinds else None)
                n = df.count() if problem is None else -1
            else:
                problem, n = None, fn(spark, sf).count()
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        took = time.time() - t0
        status = "OK  " if problem is None and n > 0 else ("EMPTY" if problem is None else "FAIL")
        bad += status != "OK  "
        print(f"{status} {name:40s} {n:8d} {took:6.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
