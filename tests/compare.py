"""Run registered queries in Spark and their SQL in DuckDB and compare the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    dn = [d[0] for d in cur.description]
    dt = {d[0]: str(d[1]) for d in cur.description}
    drows = cur.fetchall()
    sn = df.columns
    srows = [tuple(r) for r in df.collect()]
    if sorted(sn) != sorted(dn):
        return f"columns {sorted(sn)} vs {sorted(dn)}", len(srows)
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    for n, t in df.dtypes:
        want = simple.get(t)
        if want and want != dt[n]:
            return f"type of {n}: {t} vs {dt[n]}", len(srows)
    a, b = rows(sn, srows), rows(dn, drows)
    if a == b:
        return None, len(a)
    sa, sb = set(a), set(b)
    only_a = [r for r in a if r not in sb][:2]
    only_b = [r for r in b if r not in sa][:2]
    return (f"{len(a)} vs {len(b)} rows; spark only {len(sa - sb)}, sql only {len(sb - sa)}; "
            f"spark {str(only_a)[:600]} sql {str(only_b)[:600]}"), len(a)


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from inkquest.session import build_session

    folder = argv[0]
    want = argv[1:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in qs:
        if want and not any(w in name for w in want):
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, folder)
            if name in sqls:
                diff, n = compare(df, con, sqls[name])
            else:
                diff, n = None, df.count()
        except Exception as ex:  # report and go on
            diff, n = f"{type(ex).__name__}: {str(ex)[:900]}", -1
        dt = time.time() - t0
        bad += diff is not None
        tag = "ok  " if diff is None else "FAIL"
        kind = "sql " if name in sqls else "rows"
        print(f"{tag} {kind} {dt:6.1f}s {n:7d} {name}{'' if diff is None else '  ' + diff}", flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
