"""Compare a query with its SQL, run by DuckDB on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    frame = frame[columns].astype(object)
    values = frame.where(frame.notna(), None).values.tolist()
    return sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in values)


def same(query, sql, spark, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.sql(sql).df(), query(spark, folder).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
