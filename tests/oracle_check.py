"""Runs queries next to their SQL twins: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(value):
    return repr(value) if not isinstance(value, float) else f"{value:.9g}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    table = df.toArrow()
    ours = rows_of(df.columns, zip(*[c.to_pylist() for c in table.columns]) if table.num_rows else [])
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"no SQL, {len(ours[1])} rows, {seconds:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.sql(sql).to_arrow_table()
    theirs = rows_of(result.column_names, zip(*[c.to_pylist() for c in result.columns]) if result.num_rows else [])
    types = {f.name: str(f.type).replace("large_", "") for f in table.schema}
    sql_types = {f.name: str(f.type).replace("large_", "") for f in result.schema}
    note = f"{len(ours[1])} rows, spark {seconds:.1f}s, sql {time.time() - start - seconds:.1f}s"
    if ours == theirs and types == sql_types and ours[1]:
        return True, note
    only = [r for r in ours[1] if r not in set(theirs[1])][:2]
    missing = [r for r in theirs[1] if r not in set(ours[1])][:2]
    diff = {k: (types.get(k), sql_types.get(k)) for k in types | sql_types if types.get(k) != sql_types.get(k)}
    return False, f"{note} vs {len(theirs[1])} types {diff}\n  spark {only}\n  sql   {missing}"


def main() -> None:
    from codesieve.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, sys.argv[1], name)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += [] if ok else [name]
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
