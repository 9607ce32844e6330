"""Compare registered queries with their DuckDB texts on the test tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _text(value) -> str:
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return "∅"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def differences(spark, db, query, sql: str, folder: str) -> list[str]:
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [
        f"{len(ours)} rows against {len(theirs)}",
        *[f"only here: {str(r)[:400]}" for r in sorted(a - b)[:3]],
        *[f"only there: {str(r)[:400]}" for r in sorted(b - a)[:3]],
    ]


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from gleaner.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    db = connect(folder)
    texts = oracle_sql()
    bad = 0
    for name in wanted:
        begin = time.time()
        try:
            if name in texts:
                found = differences(spark, db, queries()[name], texts[name], folder)
            else:
                found = [] if queries()[name](spark, folder).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [str(error)[:1500]]
        bad += bool(found)
        print(name, "ok" if not found else "DIFFERS", f"{time.time() - begin:.1f}s", flush=True)
        for line in found:
            print("   ", line)
    print(len(wanted), "queries,", bad, "differ")
