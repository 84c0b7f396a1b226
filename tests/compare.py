"""Run queries in Spark and their SQL in DuckDB and report differences.

    python tests/compare.py [sf dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "tinyint": "int", "smallint": "int", "integer": "int", "bigint": "long", "double": "double", "varchar": "string",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp", "float": "float", "int": "int",
}
SPARK = {"bigint": "long", "int": "int", "double": "double", "string": "string", "boolean": "boolean", "date": "date"}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for file in sorted(os.listdir(folder)):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{folder}/{file}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, folder: str, name: str, limit: int = 3) -> str | None:
    """None when both agree, else what differs."""
    from reviewlens.suite import CHECKS, check_sql, runner

    df = runner(name)(spark, folder)
    columns = sorted(df.columns)
    kinds = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in CHECKS:
        return None if got else "no rows"
    rel = con.sql(check_sql(name))
    wanted = {c: KINDS.get(str(t).lower(), str(t).lower()) for c, t in zip(rel.columns, rel.types)}
    if sorted(wanted) != columns:
        return f"columns {columns} != {sorted(wanted)}"
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + " from rel").fetchall()
    problems = []
    if kinds != wanted:
        problems.append("types " + str({c: (kinds[c], wanted[c]) for c in columns if kinds[c] != wanted[c]}))
    got, want = sorted(got, key=key), sorted(want, key=key)
    if not got:
        problems.append("no rows")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        only_got, only_want = list(set(got) - set(want))[:limit], list(set(want) - set(got))[:limit]
        problems.append(f"\n  columns {columns}\n  spark {only_got}\n  check {only_want}")
    return "; ".join(problems) or None


def main(argv: list[str]) -> int:
    from reviewlens.session import local_session
    from reviewlens.suite import QUERIES

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s {problem or ''}"[:2500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
