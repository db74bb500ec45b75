"""Run registered queries beside their SQL and compare rows: ``python tests/oracle_check.py [sf] [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def row_bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    want, have = row_bag(names, cursor.fetchall()), row_bag(df.columns, [tuple(r) for r in df.collect()])
    if want == have:
        return None
    missing, extra = want - have, have - want
    return (f"rows {sum(have.values())} against {sum(want.values())}; missing {sum(missing.values())} "
            f"{list(missing)[:2]}; extra {sum(extra.values())} {list(extra)[:2]}; order {sorted(names)}")


def main() -> None:
    from clinspark.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    oracle, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"(rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        ok = problem is None or problem.startswith("(rows")
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
