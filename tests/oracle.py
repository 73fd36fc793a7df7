"""Compare a query with its SQL twin, order-insensitively."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:1]} / {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; cols {got_cols} e.g. {bad[0][0]} != {bad[0][1]}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    from hostlens.session import local_session

    sf = "/root/testdata/sf0.01"
    args = list(argv)
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    twins_only = "--twins" in args
    args = [a for a in args if a != "--twins"]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, oracles = e.queries(), e.oracle_sql()
    names = [n for n in qs if (not args or any(a in n for a in args)) and (n in oracles or not twins_only)]
    failed = []
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in oracles:
                err = compare(df, con, oracles[n])
                extra = ""
            else:
                rows = df.collect()
                err, extra = None if rows else "no rows", f" (rows only: {len(rows)}) {rows[:2]}"
        except Exception as ex:  # noqa: BLE001
            err, extra = f"{type(ex).__name__}: {str(ex)[:700]}", ""
        if err:
            failed.append(n)
        print(f"{'FAIL' if err else 'ok  '} {n} {time.time() - t:.1f}s {err or extra}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
