"""Compare queries with their SQL: ``python tests/compare.py FOLDER [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def as_multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def connect(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def difference(spark_rows, spark_columns, db, sql):
    """None when both results agree, else a short description."""
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    ours, our_names = as_multiset(spark_columns, [tuple(r) for r in spark_rows])
    theirs, their_names = as_multiset(names, got.fetchall())
    if our_names != their_names:
        return f"columns {our_names} != {their_names}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"rows {len(ours)} vs {len(theirs)}; ours {sorted(a)[:2]} theirs {sorted(b)[:2]}"[:900]
    return None


def main():
    import __spark_entry__ as entry

    from rollbook.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8, memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    db, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            rows = df.collect()
            problem = difference(rows, df.columns, db, oracles[name]) if name in oracles else None
            state = ("ok" if name in oracles else "no sql") if problem is None else f"DIFFERS {problem}"
        except Exception as failure:
            state, rows = f"FAILS {type(failure).__name__} {str(failure)[:700]}", []
        bad += not state.startswith(("ok", "no sql"))
        print(f"{name:32s} {time.time() - start:6.1f}s {len(rows):8d} {state}", flush=True)
    print("differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
