"""Compare registered queries with their DuckDB twins.

Usage: python tests/oracle.py [sf_dir] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def normalize(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    want = normalize([c[0] for c in cur.description], cur.fetchall())
    df = query(spark, sf_dir)
    got = normalize(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            i = next(i for i, (a, b) in enumerate(zip(g, w)) if a != b)
            return f"{got[0][i]}: {g[i][:300]!r} != {w[i][:300]!r} in {str(g)[:200]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from commentlake.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                diff = None if n else "no rows"
                name = f"{name} ({n} rows)"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - start:6.2f}s {name} {diff or ''}", flush=True)
    print("unmatched oracles:", sorted(set(oracles) - set(queries)))
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
