"""Compare a Spark result with its SQL twin: same columns, rows and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(close(x, y) for x, y in zip(a, b))
    return a == b


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short description."""
    names_s, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names_d = [d[0] for d in cur.description]
    names_d, want = rows_of(names_d, cur.fetchall())
    if names_s != names_d:
        return f"columns {names_s} != {names_d}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {sorted(set(got) - set(want), key=repr)[:2]}; only sql {sorted(set(want) - set(got), key=repr)[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return None
    if all(close(g, w) for g, w in bad):
        return f"FUZZY {len(bad)} of {len(got)}: {bad[0]}"
    return f"values differ in {len(bad)} of {len(got)}: {bad[0]}"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from __spark_entry__ import oracle_sql, queries

    from strideframe.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                msg = difference(df, con, sqls[name])
                note = f"{df.count() if msg is None and wanted else ''}"
            else:
                msg, note = None, f"rows={df.count()} (no sql)"
        except Exception as e:  # report and go on
            msg, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        took = time.time() - t0
        if msg or wanted or took > 6:
            print(f"{'OK  ' if msg is None else 'BAD '} {name} {took:.1f}s {note} {msg or ''}", flush=True)
        bad += msg is not None
    print("failures:", bad)


if __name__ == "__main__":
    main()
