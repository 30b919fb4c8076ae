"""Queries against their SQL on the smallest test tables, where those are at hand."""

from __future__ import annotations

from pathlib import Path

FOLDER = "/root/testdata/sf0.001"


def plain(value: object) -> object:
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def same(spark, name: str, query, sql: str) -> None:
    import duckdb

    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = query(spark, FOLDER)
    rel = db.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), name
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    assert got == want, name
