"""Run a registered query and its SQL on the same tables and compare the rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


def differences(spark, frame, sql, sf_dir):
    """(rows of the query alone, rows of the SQL alone, number of rows), columns by name."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(sql)
    names = sorted(frame.columns)
    assert sorted(want.columns) == names, (sorted(want.columns), names)
    mine = sorted((tuple(norm(r[n]) for n in names) for r in frame.collect()), key=repr)
    order = [want.columns.index(n) for n in names]
    theirs = sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=repr)
    a, b = list(mine), list(theirs)
    from collections import Counter

    x, y = Counter(map(repr, a)), Counter(map(repr, b))
    return list((x - y).elements()), list((y - x).elements()), len(mine)
