"""Compare a query with its SQL: rows as multisets, columns by name, floats rounded."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def compare(df, con, sql):
    want = con.execute(sql).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(df.columns) == names
    rows = Counter(tuple(norm(r[c]) for c in names) for r in df.collect())
    expected = Counter(tuple(norm(r[c]) for c in names) for r in want.to_pylist())
    missing, extra = expected - rows, rows - expected
    assert not missing and not extra, (sum(missing.values()), list(missing)[:2], sum(extra.values()), list(extra)[:2])
