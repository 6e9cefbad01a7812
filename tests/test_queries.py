"""Every query with SQL gives what DuckDB gives on the same Parquet files."""

import math

import duckdb
import pytest

from tidewell.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, sf_dir):
    """Filters and the columns in use reach the scan."""
    from pyspark.sql import functions as F

    from tidewell.model import metrics

    plan = metrics(spark, sf_dir).where(F.col("sensor_id") == "click").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
