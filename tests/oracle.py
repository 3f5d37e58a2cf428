"""Compare registered queries with their SQL on DuckDB: schema, row count and values.

    python -m tests.oracle [folder] [query-name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "int",
    "float": "float", "double": "float", "string": "string", "varchar": "string", "boolean": "bool",
    "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
}


def kind(type_name: str) -> str:
    return KINDS.get(type_name.lower(), type_name.lower())


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v).__name__), str(v)) for v in row)


def duckdb_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found, empty when the results agree."""
    names = sorted(spark_df.columns)
    spark_kinds = {f.name: kind(f.dataType.simpleString()) for f in spark_df.schema}
    result = con.execute(sql)
    duck_names = [d[0] for d in result.description]
    duck_kinds = {d[0]: kind(str(d[1])) for d in result.description}
    rows = result.fetchall()
    if sorted(duck_names) != names:
        return [f"columns differ: {names} / {sorted(duck_names)}"]
    found = [f"type of {c}: {spark_kinds[c]} / {duck_kinds[c]}" for c in names if spark_kinds[c] != duck_kinds[c]]
    order = [duck_names.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=sort_key)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()), key=sort_key)
    if len(ours) != len(theirs):
        found.append(f"rows: {len(ours)} / {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return found


def main() -> int:
    from paneloom.session import build_session
    from paneloom.plans import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_connection(folder)
    failures = 0
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            found = compare(df, con, ORACLES[name]) if name in ORACLES else []
            note = "" if name in ORACLES else f" (rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001 - report and go on
            found, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        took = time.time() - start
        failures += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {took:.2f}s{note}", *found, sep="\n       " if found else "", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main() > 0)
