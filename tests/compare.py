"""Run registered queries against their SQL; `python tests/compare.py [name ...]`."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(table) -> tuple[list[str], Counter]:
    """Column names in order and the multiset of rows of an Arrow table."""
    names = sorted(table.column_names)
    return names, Counter(zip(*[table[n].to_pylist() for n in names])) if table.num_rows else Counter()


def difference(spark_table, sql_table) -> str | None:
    left_names, left = rows_of(spark_table)
    right_names, right = rows_of(sql_table)
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    a, b = kinds(spark_table), kinds(sql_table)
    if a != b:
        return f"types {[(n, a[n], b[n]) for n in a if a[n] != b[n]]}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (f"rows {sum(left.values())} against {sum(right.values())}; only Spark {sum(only_left.values())} "
                f"{sorted(only_left, key=str)[:3]}; only SQL {sorted(only_right, key=str)[:3]}")
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from lexiloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracles, failed = duck(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            result = queries[name](spark, sf_dir).toArrow()
            took = time.time() - began
            if name in oracles:
                verdict = difference(result, con.sql(oracles[name]).to_arrow_table())
            else:
                verdict = None if result.num_rows else "no rows"
            sql_took = time.time() - began - took
        except Exception as failure:
            verdict, took, sql_took, result = f"{type(failure).__name__}: {str(failure)[:400]}", 0, 0, None
        failed += verdict is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if verdict else 'ok':4} {kind:4} {name:32} {0 if result is None else result.num_rows:8} "
              f"{took:6.1f}s {sql_took:6.1f}s {verdict or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
