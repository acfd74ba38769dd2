"""Side-by-side runs of a query and its SQL, compared without order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings work massime llm_resolver_result normativa
normativa_altalex normativa_vigenza normativa_chunk normativa_chunk_embeddings sync_run sync_item""".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value.isoformat() if isinstance(value, dt.date) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def difference(spark, con, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} rows against {len(want[1])}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    import sys
    import time
    import traceback

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from fondaco.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, queries, sqls = local_session(8), duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        began = time.time()
        try:
            if name in sqls:
                said = difference(spark, con, queries[name], sqls[name], sf_dir)
            else:
                said = "" if (n := queries[name](spark, sf_dir).count()) else "no rows"
        except Exception:
            said = traceback.format_exc()[-1500:]
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok'} {name} {time.time() - began:.1f}s {said}", flush=True)
    print("failures:", bad)
