"""Hold a query against its SQL statement in DuckDB, on the smallest test tables."""

import math
import os

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def same_rows(spark, query, sql):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(TABLES):
        c.execute(f"create view {name.split('.')[0]} as select * from '{TABLES}/{name}'")
    df = query(spark, TABLES)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).toPandas().itertuples(index=False, name=None)), key=repr)
    answer = c.execute(sql)
    found = [d[0] for d in answer.description]
    assert sorted(found) == names
    want = sorted((tuple(plain(r[found.index(n)]) for n in names) for r in answer.fetchall()), key=repr)
    assert got == want
    assert len(got) > 0
