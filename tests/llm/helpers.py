"""Registered queries against their DuckDB text."""

import duckdb


def same_as_duckdb(spark, name, sf_dir, tables=("documents", "benchmark", "labels", "pages")):
    from tripweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[columns].itertuples(index=False))
    a, b = rows(got), rows(want)
    assert a == b, [x for x in zip(a, b, strict=False) if x[0] != x[1]][:5]
    return got
