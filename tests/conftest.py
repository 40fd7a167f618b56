import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_as_sql(spark, name, query, sql, folder=SF):
    """Holds a query against DuckDB on the same files: names, number and values of all rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = query(spark, folder)
    wanted = con.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(got.columns), name
    order = sorted(names)
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    a = sorted(tuple(text(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(text(r[names.index(c)]) for c in order) for r in wanted.fetchall())
    assert a == b, f"{name}: {len(a)} and {len(b)} rows; {list(set(a) ^ set(b))[:4]}"
