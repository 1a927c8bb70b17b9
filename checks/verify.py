"""Run registered queries beside their SQL and compare whole results.

    python -m checks.verify [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.queries import ORACLE, QUERIES
from mailrisk.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value if isinstance(value, bool) else str(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session()
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failed = 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            got = _rows(frame.columns, frame.collect())
            spent = time.time() - started
            if name not in ORACLE:
                print(f"rows  {name:26} {len(got):7} rows {spent:6.2f}s  {got[:1]}", flush=True)
                continue
            answer = db.execute(ORACLE[name])
            columns = [d[0] for d in answer.description]
            want = _rows(columns, answer.fetchall())
            ok = sorted(columns) == sorted(frame.columns) and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name:26} {len(got):7} rows {spent:6.2f}s", flush=True)
            if not ok:
                failed += 1
                print("   columns", sorted(frame.columns), sorted(columns), "rows", len(got), len(want))
                for label, rows in (("spark", set(got) - set(want)), ("sql  ", set(want) - set(got))):
                    for row in sorted(rows, key=repr)[:2]:
                        print("  ", label, str(row)[:600])
            types = dict(frame.dtypes)
            sql_types = dict(zip(columns, [str(d[1]) for d in answer.description]))
            if ok:
                odd = {c: (types[c], sql_types[c]) for c in columns if not _same_type(types[c], sql_types[c])}
                if odd:
                    print("   types", odd)
        except Exception as exc:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    return failed


def _same_type(spark_type: str, sql_type: str) -> bool:
    pairs = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    return pairs.get(spark_type, "?") == sql_type.upper()


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(min(1, main(folder, args[1:])))
