"""Run registered queries and compare them with DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return 0.0 if value == 0 else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(spark_df, con, sql: str):
    """(spark rows, duckdb rows, up to three rows on each side that do not match)."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return None, None, (sorted(spark_df.columns), sorted(names))
    order = sorted(names)
    theirs = [tuple(plain(v) for v in r) for r in cursor.fetchall()]
    at = [names.index(n) for n in order]
    theirs = [tuple(r[i] for i in at) for r in theirs]
    ours = [tuple(plain(v) for v in r) for r in spark_df.select(*order).collect()]
    from collections import Counter

    a, c = Counter(ours), Counter(theirs)
    return len(ours), len(theirs), (list((a - c).items())[:3], list((c - a).items())[:3])


def main(sf_dir: str, only: str | None = None):
    import sys

    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from knowndate.session import local_session

    spark, con = local_session(), connect(sf_dir)
    bad = []
    for name, fn in queries().items():
        if only and only not in name:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"{name:45s} rows={df.count()} (no oracle) {time.time() - start:.1f}s", flush=True)
                continue
            ours, theirs, diff = differences(df, con, sql)
            ok = ours == theirs and ours is not None and not diff[0] and not diff[1]
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            ok, ours, theirs, diff = False, None, None, str(exc)[:700]
        took = time.time() - start
        print(f"{name:45s} {'ok' if ok else 'DIFF'} {ours} {theirs} {took:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            print("   ", diff, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    import sys

    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else None)
