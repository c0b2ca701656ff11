"""Run registered queries next to their SQL and compare the results."""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


# Queries without SQL and the test that checks their operator against a model.
TESTED_ELSEWHERE: dict[str, str] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([_plain(r[i]) for i in order]) for r in rows))


def compare(spark, con, query, sf_dir):
    start = time.time()
    df = entry.queries()[query.name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if query.sql is None:
        test = TESTED_ELSEWHERE.get(query.name)
        return test is not None, f"rows {len(got)}, no SQL; see {test}", spent
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", spent
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return False, f"rows {len(a)} vs {len(b)}\n  {sorted(names)}\n  spark {only_a[:3]}\n  sql   {only_b[:3]}", spent
    return True, f"rows {len(a)}", spent


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    from speechlake.plans import REGISTRY
    from speechlake.session import local_session

    spark, con, failed = local_session(8), connect(args.sf), []
    for q in REGISTRY.values():
        if args.names and not any(n in q.name for n in args.names):
            continue
        try:
            if args.explain:
                q.plan(spark, args.sf).explain("formatted")
            ok, note, spent = compare(spark, con, q, args.sf)
        except Exception as error:  # report and go on with the next query
            ok, note, spent = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        print(("ok  " if ok else "FAIL"), f"{spent:6.2f}s", q.name, note, flush=True)
        if not ok:
            failed.append(q.name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
