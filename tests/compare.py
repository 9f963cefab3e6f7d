"""Runs the registered queries and their SQL twins side by side.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

TABLES = ("events", "documents", "conversations", "pages", "embeddings", "labels", "benchmark")


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [[row[i] for i in order] for row in rows]
    return sorted(names), sorted(cells, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, db, sf_dir, name):
    """None if equal, else what differs. `rows` if there is no twin."""
    found = E.queries()[name](spark, sf_dir)
    mine = canonical(found.columns, found.collect())
    sql = E.oracle_sql().get(name)
    if sql is None:
        return "no twin", len(mine[1])
    result = db.execute(sql)
    theirs = canonical([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} {theirs[0]}", len(mine[1])
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows, expected {len(theirs[1])}", len(mine[1])
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"\n   {a}\n   {b}", len(mine[1])
    return None, len(mine[1])


def main():
    from gatehouse.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(E.queries())
    spark = build_session(
        "compare",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = database(sf_dir)
    for name in names:
        begin = time.time()
        try:
            problem, rows = compare(spark, db, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", 0
        state = "ok" if problem is None else problem
        print(f"{name:28} {rows:8} rows {time.time() - begin:6.1f} s  {state}", flush=True)


if __name__ == "__main__":
    main()
