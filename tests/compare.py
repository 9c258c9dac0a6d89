"""Runs a query and its SQL over the same tables and compares them as sets of rows with counts."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection(sf_dir: Path = DATA):
    con = duckdb.connect()
    for p in sorted(sf_dir.glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark, con, query, sql: str, sf_dir: Path = DATA) -> None:
    got = query(spark, str(sf_dir))
    cols = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    rows = Counter(repr(tuple(r[c] for c in cols)) for r in got.collect())
    told = Counter(repr(tuple(r)) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert rows == told, (list((rows - told).items())[:2], list((told - rows).items())[:2])
