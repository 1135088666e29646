"""Spark-versus-DuckDB comparison, the same kind of check the driver runs.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of
normalised rows for each query that has an oracle.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(spark_df, con, sql: str):
    """Columns whose Spark type and DuckDB type differ."""
    duck = dict((r[0], r[1]) for r in con.execute(f"DESCRIBE ({sql})").fetchall())
    out = []
    for f in spark_df.schema.fields:
        st = f.dataType.simpleString()
        want = SPARK_TO_DUCK.get(st, st.upper())
        if duck.get(f.name) != want:
            out.append(f"{f.name}:{st}/{duck.get(f.name)}")
    return out


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    sc, sm = canon(s_cols, s_rows)
    dc, dm = canon(d_cols, d_rows)
    ok = sc == dc and sm == dm
    detail = ""
    types = type_mismatches(spark_df, con, sql) if sc == dc else []
    if types:
        detail = f"types {types} "
    if sc != dc:
        detail += f"columns spark={sc} duck={dc}"
    elif sm != dm:
        only_s = list((sm - dm).elements())[:3]
        only_d = list((dm - sm).elements())[:3]
        detail += f"rows spark={len(s_rows)} duck={len(d_rows)}; only spark {only_s}; only duck {only_d}"
    return ok, len(s_rows), len(d_rows), detail


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from tillroll.session import build_session
    spark = build_session()
    con = duck_connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            t = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name:32s} rows={n} ({time.time() - t:.1f}s)")
            continue
        t = time.time()
        try:
            ok, ns, nd, detail = compare(qs[name](spark, sf_dir), con, sqls[name])
        except Exception as exc:  # report and go on
            ok, ns, nd, detail = False, -1, -1, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name:32s} spark={ns} duck={nd} ({time.time() - t:.1f}s) {detail}")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
