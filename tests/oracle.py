"""Compare a query with its SQL on another engine, as sets of rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_canon(r[n]) for n in names) for r in df.toLocalIterator())


def sql_rows(con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(_canon(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, otherwise what differs."""
    names, got = spark_rows(fn(spark, sf_dir))
    want_names, want = sql_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got == want:
        return "" if sum(got.values()) else "EMPTY"
    a, b = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows {sum(got.values())} vs {sum(want.values())}; spark only {a}; sql only {b}"


def main(sf: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                note = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                note = "" if n else "EMPTY"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(note)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if note else 'ok'} {name} [{kind}] {time.time() - t0:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
