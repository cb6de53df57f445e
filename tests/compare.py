"""Results of a query against those of its SQL."""

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


def sql_rows(sql: str, sf: str):
    c = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    found = c.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def tidy(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def same(spark, name, query, sql, sf="sf0.001"):
    df = query(spark, str(DATA / sf))
    a, b = tidy(df.columns, [tuple(r) for r in df.collect()]), tidy(*sql_rows(sql, sf))
    assert a[0] == b[0], name
    assert len(a[1]) == len(b[1]), (name, len(a[1]), len(b[1]))
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not wrong, (name, wrong[:3])
