"""Run registered queries next to their oracle SQL and compare the rows.

usage: python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codesieve.plans import ORACLE, QUERIES  # noqa: E402
from codesieve.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return None
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if got == want:
        types = dict(zip(columns, con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()))
        same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        odd = [f"{c}: {t} != {types[c][1]}" for c, t in df.dtypes if t in same and same[t] != types[c][1]]
        return f"types {odd}" if odd else ("no rows" if not got else None)
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"{len(got)} rows != {len(want)}; only spark {extra[:2]}; only sql {missing[:2]}"


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark, con, bad = local_session("8"), connect(opts.sf), 0
    for name in opts.names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, opts.sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in ORACLE else '(no sql)'} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
