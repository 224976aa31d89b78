"""Compare catalog queries with their SQL on the supplied tables.

    python tests/compare.py SF_DIR [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def sides(spark, con, sf, name, queries, oracles):
    frame = queries[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in frame.collect())
    types = {n: t for n, t in frame.dtypes}
    if name not in oracles:
        return got, None, columns, columns, types, {}
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(normal(r[i]) for i in order) for r in cur.fetchall())
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return got, want, columns, [names[i] for i in order], types, kinds


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
    "date": "DATE",
}


def problem(got, want, columns, names, types, kinds):
    if want is None:
        return None
    if columns != names:
        return f"columns {columns} / {names}"
    wrong = [(n, types[n], kinds[n]) for n in columns if SAME.get(types[n]) != kinds[n]]
    if wrong:
        return f"types {wrong}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    from tapeloom.catalog import load
    from tapeloom.session import local_session

    sf, picked = sys.argv[1], sys.argv[2:]
    spark = local_session(8, "compare", shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = duck(sf)
    names = [n for n in queries if not picked or any(n.startswith(x) for x in picked)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            got, want, *rest = sides(spark, con, sf, name, queries, oracles)
            issue = problem(got, want, *rest)
        except Exception as error:  # noqa: BLE001
            got, want, issue = [], [], f"{type(error).__name__}: {str(error)[:700]}"
        bad += issue is not None
        state = "FAIL" if issue else ("ok  " if want is not None else "rows")
        print(f"{state} {name} rows={len(got)} {time.time() - t:.1f}s {issue or ''}", flush=True)
    print("bad", bad, "of", len(names))
