"""Run registered queries next to their SQL twins: ``python -m tests.check [prefix ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, d):
    """None when both sides agree, else what differs."""
    df = query(spark, d)
    got = table_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {c[0]: str(c[1]).lower() for c in cur.description}
    pairs = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
    odd = {c: (types[c], duck[c]) for c in types if pairs.get(types[c], types[c]) != duck[c]}
    if diff:
        return f"{len(diff)} of {len(got[1])} rows differ, first {diff[0]}"
    if odd:
        return f"types {odd}"
    return None if got[1] else "EMPTY"


def main() -> None:
    sys.path.insert(0, os.getcwd())
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    d = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(d)
    wanted = sys.argv[1:]
    twins, bad = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in twins:
                problem = compare(spark, con, name, query, twins[name], d)
            else:
                n = query(spark, d).count()
                problem = None if n else "EMPTY"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        if problem or "-v" in wanted or time.time() - start > 6:
            print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"done, {bad} problems", flush=True)


if __name__ == "__main__":
    main()
