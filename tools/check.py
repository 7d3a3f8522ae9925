"""Compare registered queries with their SQL: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import signal
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from feedloom.plans import catalog  # noqa: E402
from feedloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple((type(row[i]).__name__, row[i]) for i in order))
    return sorted(columns), sorted(out, key=repr)


def too_long(*_):
    raise TimeoutError("over the time limit of one query")


def main() -> int:
    limit = int(os.environ.get("LIMIT", "300"))
    signal.signal(signal.SIGALRM, too_long)
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles = catalog.all_queries(), catalog.all_oracles()
    if wanted and wanted[0].startswith("@"):
        mods = wanted[0][1:].split(",")
        names = [n for n, f in catalog._QUERIES.items() if f.__module__.split(".")[-1][:-8] in mods]
    else:
        names = wanted or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        signal.alarm(limit)
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - t0
            if name not in oracles:
                print(f"rows  {name}: {len(got[1])} rows {spent:.1f}s", flush=True)
                continue
            t1 = time.time()
            cur = db.execute(oracles[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            sql_spent = time.time() - t1
            same = got == want
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got[1])} rows {spent:.1f}s (sql {sql_spent:.1f}s)", flush=True)
            if not same:
                print("   columns", got[0], want[0], len(got[1]), len(want[1]))
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                for label, extra in (("spark", a - b), ("sql", b - a)):
                    for r in sorted(extra)[:3]:
                        print("   ", label, r[:600])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
