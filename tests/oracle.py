"""Compares a query with its DuckDB counterpart, as the driver does: names, counts and values without order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _rows(df):
    plain = lambda v: None if v is None else v.item() if hasattr(v, "item") else v
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


def check(spark, con, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    ours, theirs = (df.astype({c: "float64" for c in df.columns if df[c].dtype.kind in "iuf"}) for df in (ours, theirs))
    assert _rows(ours) == _rows(theirs)
