"""Runs registered queries on Spark and DuckDB and reports differences."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(row[k] for k in order) for row in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark, con, fn, sql, sf) -> str | None:
    """None when row count, columns, types and values agree."""
    df = fn(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if join in plan:
            return f"{join} in the plan"
    got = [tuple(row) for row in df.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} vs {names}"
    types = {c[0]: str(c[1]) for c in cursor.description}
    for column, kind in df.dtypes:
        if KINDS.get(kind) != types[column]:
            return f"type of {column}: {kind} vs {types[column]}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got, df.columns), normal(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or (p != p and q != q) for p, q in zip(x, y))]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    if any(isinstance(v, float) and math.isnan(v) for row in a for v in row):
        return "NaN in the result"
    return None


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from marginwise.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        begin = time.time()
        try:
            problem = difference(spark, con, queries[name], oracles[name], sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - begin:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
