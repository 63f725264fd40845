"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def compare(spark, con, sf, name, run, sql):
    """None when equal, else what differs."""
    df = run(spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a = sorted(set(got) - set(want), key=repr)[:2]
        b = sorted(set(want) - set(got), key=repr)[:2]
        return f"{len(got)} rows against {len(want)}: {str(a)[:600]} / {str(b)[:600]}"
    return None


if __name__ == "__main__":
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry

    from linkloom.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name, queries[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {'' if name in sqls else '(rows only)'} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
