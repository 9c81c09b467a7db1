"""Compare registered queries with their SQL twins in DuckDB.

    python tests/oracle.py [folder] [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(round(float(value), 7) + 0.0))
    return (3, str(value))


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    left = normal_rows(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = normal_rows(columns, result.fetchall())
    if sorted(spark_df.columns) != sorted(columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    kinds = {}
    for name, kind in zip(columns, [str(d[1]) for d in result.description]):
        kinds[name] = kind
    odd = {n: k for n, k in kinds.items() if k in ("HUGEINT",) or k.startswith("DECIMAL")}
    if odd:
        return f"SQL types {odd}"
    if left != right:
        only_left = [x for x in left if x not in set(right)][:3]
        only_right = [x for x in right if x not in set(left)][:3]
        return f"rows {len(left)} vs {len(right)}\n   spark {only_left}\n   sql   {only_right}"
    return None


def main() -> None:
    from veritab.queries import all_queries, all_sql
    from veritab.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = all_sql()
    bad = 0
    for name, build in all_queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            if name in sql:
                problem = compare(frame, con, sql[name])
            else:
                rows = frame.count()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
