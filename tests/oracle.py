"""Run registered queries against their SQL in DuckDB.

    python -m tests.oracle [sf0.01] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return _plain(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


_KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "hugeint": "hugeint", "integer": "int",
    "string": "varchar", "varchar": "varchar", "double": "double", "float": "float", "date": "date",
    "timestamp_ntz": "timestamp", "timestamp": "timestamp", "boolean": "boolean",
}


def compare(spark, con, sf_dir, query, sql) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    types = dict(df.dtypes)
    mine = [tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()]
    rel = con.execute(sql)
    head = [(d[0], str(d[1]).lower()) for d in rel.description]
    rows = rel.fetchall()
    if sorted(h[0] for h in head) != names:
        return False, f"columns {names} != {sorted(h[0] for h in head)}"
    odd = [
        (n, types[n], t) for n, t in head if _KIND.get(types[n], types[n]) != _KIND.get(t, t)
    ]
    at = {h[0]: i for i, h in enumerate(head)}
    theirs = [tuple(_plain(r[at[n]]) for n in names) for r in rows]
    note = f" TYPES {odd}" if odd else ""
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}{note}"
    order = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    mine.sort(key=order)
    theirs.sort(key=order)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(mine)} differ, e.g. {names}\n    {bad[0][0]}\n    {bad[0][1]}{note}"
    return not odd, f"{len(mine)} rows{note}"


def main(argv: list[str]) -> int:
    import __spark_entry__
    from gatecount.session import session

    sf = "sf0.01"
    if argv and argv[0].startswith("sf"):
        sf, argv = argv[0], argv[1:]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = session("oracle", 8), connect(sf_dir)
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    failed = 0
    for name in argv or queries:
        t = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                ok, note = True, f"{queries[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28} {time.time() - t:6.2f}s  {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
