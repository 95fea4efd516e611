"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=_key)


def duck_rows(con, sql: str):
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=_key)


def compare(spark, con, sf_dir, name, query, sql) -> str | None:
    """None when rows agree, else what differs."""
    cols, got = spark_rows(query(spark, sf_dir))
    want_cols, want = duck_rows(con, sql)
    if cols != want_cols:
        return f"columns {cols} against {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2] if len(got) < 3000 else []
        missing = [r for r in want if r not in got][:2] if len(want) < 3000 else []
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from wayfold.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark, con = local_session(8), connection(sf)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf, name, query, oracle[name])
            else:
                problem = f"rows only: {query(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            problem = "FAILED " + str(e)[:600]
        print(f"{'ok  ' if problem is None else '....' if problem.startswith('rows only') else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}"[:900], flush=True)
