"""Run named queries and compare them with their check SQL, value by value.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paymend.sources.views import TABLES  # noqa: E402


def canon(value):
    """Types count: 1, 1.0 and Decimal('1.00') differ."""
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(df, con, sql):
    """(ok, message)."""
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows"
    in_a, in_b = set(a), set(b)
    only_a, only_b = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
    differ = f"{len(only_a)}/{len(only_b)} differ"
    only_a, only_b = only_a[:3], only_b[:3]
    return False, f"{len(a)} vs {len(b)} rows, {differ}; cols {sorted(names)}\n   spark {only_a}\n   duck  {only_b}"


def main(argv):
    import __spark_entry__ as entry
    from paymend.session import local_session

    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        folder = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session("8")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in argv or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                ok, message = compare(df, con, oracles[name])
            else:
                ok, message = True, f"{len(df.collect())} rows, no check SQL"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
