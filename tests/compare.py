"""Runs queries and their SQL side by side: python -m tests.compare [dir] [name ...]."""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)), key=str)


def plain(v):
    import datetime

    if isinstance(v, datetime.datetime):
        return str(v.date()) if (v.hour, v.minute, v.second) == (0, 0, 0) else str(v)
    if isinstance(v, datetime.date):
        return str(v)
    return v.item() if hasattr(v, "item") else v


def check(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    out = con.sql(sql)
    assert sorted(out.columns) == cols, (sorted(out.columns), cols)
    at = [out.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)
    assert len(got) == len(want), f"{name}: {len(got)} rows, SQL has {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, f"{name}: {len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return len(got)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    sql = e.oracle_sql()
    names = sys.argv[2:] or [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    for n in names:
        t = time.time()
        try:
            k = check(s, n, e.queries()[n], sql[n], sys.argv[1]) if n in sql else e.queries()[n](s, sys.argv[1]).count()
            print("ok " if n in sql else "-- ", n, k, round(time.time() - t, 1), flush=True)
        except Exception as x:
            print("BAD", n, str(x)[:400].replace("\n", " "), flush=True)
