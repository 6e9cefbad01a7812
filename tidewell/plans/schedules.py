"""Queries of recurrence rules and weekly blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import calendar
from tidewell.model import US, read
from tidewell.plans.registry import query

_FROM, _TO = 1_708_862_400 * US, 1_710_590_400 * US  # 2024-02-25 12:00 to 2024-03-16 12:00


@query(
    f"""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 24 AS INTEGER)) + to_minutes(CAST(c_custkey % 60 AS INTEGER)) AS start FROM customer),
      d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS day),
      t AS (SELECT k, day + (start - TIMESTAMP '2024-01-01') AS t FROM c, d WHERE CASE k % 5 WHEN 0 THEN date_diff('day', TIMESTAMP '2024-01-01', day) % (1 + k % 3) = 0 WHEN 1 THEN isodow(day) IN (1, 4) WHEN 2 THEN CAST(day AS DATE) = last_day(day) WHEN 4 THEN isodow(day) = 2 AND day(day) BETWEEN 8 AND 14 END
            UNION ALL SELECT k, unnest(generate_series(start, TIMESTAMP '2024-03-31', to_hours(CAST(5 + k % 7 AS INTEGER)))) FROM c WHERE k % 5 = 3)
    SELECT_FROM SELECT k AS rule_id, epoch_us(t) AS due FROM t WHERE epoch_us(t) > {_FROM} AND epoch_us(t) <= {_TO}"""
)
def rrule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the rule of each customer recurs in a window of twenty days."""
    k = F.col("c_custkey")
    start = F.concat(F.lit("DTSTART:20240101T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("00Z\nRRULE:FREQ="))
    kinds = (F.concat(F.lit("DAILY;INTERVAL="), 1 + k % 3), F.lit("WEEKLY;BYDAY=MO,TH"), F.lit("MONTHLY;BYMONTHDAY=-1"), F.concat(F.lit("HOURLY;INTERVAL="), 5 + k % 7), F.lit("MONTHLY;BYDAY=2TU"))
    rules = read(spark, sf_dir, "customer").select(k.cast("long").alias("rule_id"), F.concat(start, F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))).alias("rule"))
    return calendar.due_times(rules, _FROM, _TO)


_OPENS, _CLOSES = 1_709_856_000 * US, 1_712_534_400 * US  # 2024-03-08 to 2024-04-08, with the clock changes of three zones


@query(
    f"""WITH s AS (SELECT s_suppkey AS id, ['America/New_York', 'Europe/Berlin', 'Australia/Sydney'][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS zone, s_suppkey % 7 AS wd, (s_suppkey % 24) * 60 + (s_suppkey * 7) % 60 AS a, ((s_suppkey + 5) % 24) * 60 + (s_suppkey * 11) % 60 AS z FROM supplier),
      d AS (SELECT s.*, CAST(day AS DATE) AS day, CAST(epoch_us(day) + a * 60000000 AS BIGINT) AS f, CAST(epoch_us(day) + (z + CASE WHEN z <= a THEN 1440 ELSE 0 END) * 60000000 AS BIGINT) AS l
            FROM s, (SELECT unnest(generate_series(TIMESTAMP '2024-03-06', TIMESTAMP '2024-04-10', INTERVAL 1 DAY)) AS day) WHERE isodow(day) - 1 = wd
              AND CAST(day AS DATE) BETWEEN CAST((make_timestamp({_OPENS}) AT TIME ZONE 'UTC') AT TIME ZONE zone AS DATE) AND CAST((make_timestamp({_CLOSES}) AT TIME ZONE 'UTC') AT TIME ZONE zone AS DATE)),
      e AS (SELECT *, unnest([f, l]) AS face, unnest([0, 1]) AS at_end FROM d),
      o AS (SELECT *, face - (epoch_us((make_timestamp(face - 86400000000) AT TIME ZONE 'UTC') AT TIME ZONE zone) - face + 86400000000) AS c1, face - (epoch_us((make_timestamp(face + 86400000000) AT TIME ZONE 'UTC') AT TIME ZONE zone) - face - 86400000000) AS c2 FROM e),
      v AS (SELECT *, epoch_us((make_timestamp(c1) AT TIME ZONE 'UTC') AT TIME ZONE zone) = face AS v1, epoch_us((make_timestamp(c2) AT TIME ZONE 'UTC') AT TIME ZONE zone) = face AS v2 FROM o),
      c AS (SELECT id, day, at_end, f, l, unnest(CASE WHEN v1 AND v2 OR NOT (v1 OR v2) THEN [c1, c2] WHEN v1 THEN [c1] ELSE [c2] END) AS us FROM v),
      p AS (SELECT x.id, x.day, x.us AS first, y.us AS last, abs((y.us - x.us) - (x.l - x.f)) // 1000000 AS off_by FROM c AS x JOIN c AS y ON x.id = y.id AND x.day = y.day AND x.at_end = 0 AND y.at_end = 1 AND y.us > x.us),
      b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id, day ORDER BY off_by, first, last) = 1),
      x AS (SELECT id, day, off_by, unnest(['start', 'end']) AS edge, unnest([first, last]) AS us FROM b)
    SELECT_FROM SELECT id AS schedule_id, day, edge, us, off_by FROM x WHERE us > {_OPENS} AND us <= {_CLOSES}"""
)
def schedule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the weekly block of each supplier starts and ends, in three zones over their changes of the clock."""
    k = F.col("s_suppkey")
    clock = lambda h, m: F.format_string("%02d:%02d", h.cast("int"), m.cast("int"))
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    blocks = F.to_json(F.array(F.struct(pick(calendar.WEEKDAYS, 7).alias("day"), clock(k % 24, k * 7 % 60).alias("start"), clock((k + 5) % 24, k * 11 % 60).alias("end"))))
    schedules = read(spark, sf_dir, "supplier").select(k.alias("schedule_id"), pick(("America/New_York", "Europe/Berlin", "Australia/Sydney"), 3).alias("zone"), blocks.alias("blocks"))
    return calendar.block_edges(schedules, _OPENS, _CLOSES)
