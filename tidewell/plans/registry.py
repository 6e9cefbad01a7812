"""Where queries and the SQL that they are checked against are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The canonical tables in SQL, in front of every oracle.
METRICS_SQL = """
m AS (SELECT event_type AS sensor_id, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS quality FROM events),
u AS (SELECT 'u' || user_id AS sensor_id, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS quality FROM events),
h AS (SELECT sensor_id, CAST(floor(us / 3600e6) * 3600 AS BIGINT) AS bucket, avg(value) AS agg_value, count(*) AS samples FROM m GROUP BY ALL)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, for results that depend on the order of sums beyond them."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name. doubles: the columns of ``sql`` to be rounded."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split())
            body, recursive = sql.strip(), "RECURSIVE " if "RECURSIVE" in sql else ""
            body = body.removeprefix("RECURSIVE").strip()
            with_, select = (body.removeprefix("WITH").split("SELECT_FROM", 1) if "SELECT_FROM" in body else ("", body))
            ctes = METRICS_SQL + (", " + with_ if with_.strip() else "")
            ORACLE_SQL[f.__name__] = f"WITH {recursive}{ctes} SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM ({select}) AS result"
        return f

    return put
