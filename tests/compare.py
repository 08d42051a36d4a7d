"""Runs a registered query and its checking SQL side by side.

Usage: python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    names = sorted(spark_df.columns)
    got = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=_key)
    cur = con.execute(sql)
    desc = [(d[0], str(d[1])) for d in cur.description]
    place = {n: i for i, (n, _) in enumerate(desc)}
    problems = []
    if sorted(place) != names:
        return [f"columns differ: spark {names}, sql {sorted(place)}"]
    kinds = dict(spark_df.dtypes)
    for n, k in desc:
        if KINDS.get(kinds[n]) != k:
            problems.append(f"type of {n}: spark {kinds[n]}, sql {k}")
    want = sorted((tuple(r[place[n]] for n in names) for r in cur.fetchall()), key=_key)
    if len(got) != len(want):
        problems.append(f"row counts: spark {len(got)}, sql {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        problems.append(f"{len(wrong)} of {len(got)} rows differ; first: {names}\n  {wrong[0][0]}\n  {wrong[0][1]}")
    return problems


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tracelight.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = build_session("local[8]"), connect(folder)
    all_queries, oracles = queries(), oracle_sql()
    names = [n for n in all_queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = all_queries[name](spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                rows = ""
            else:
                problems, rows = [], f" rows={df.count()} (no sql)"
        except Exception as exc:  # report and go on
            problems, rows = [f"{type(exc).__name__}: {str(exc)[:900]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{rows}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
