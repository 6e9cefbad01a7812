"""Local times, weekly blocks and recurrence rules against calendar loops."""

import json
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewell.functions import calendar as C

US = 1_000_000


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * US


def resolve(spark, start, end, zone):
    df = spark.createDataFrame([(us(*start), us(*end), zone)], "a long, z long, zone string")
    r = df.select(C.block_instants(F.col("a"), F.col("z"), F.col("zone")).alias("i"), C.occurs(F.col("a"), F.col("zone")).alias("first"), C.occurs(F.col("z"), F.col("zone")).alias("last"), C.instants(F.col("z"), F.col("zone")).alias("all")).first()
    return r


def test_a_block_that_ends_in_the_gap(spark):
    r = resolve(spark, (2026, 3, 8, 1, 30), (2026, 3, 8, 2, 30), "US/Eastern")
    assert r["i"]["end"] - r["i"]["start"] == 3600 * US and r["i"]["off_by"] == 0 and (r["first"], r["last"]) == ("once", "never")
    assert r["all"] == [us(2026, 3, 8, 6, 30), us(2026, 3, 8, 7, 0), us(2026, 3, 8, 7, 30)]  # offset after, next valid minute, offset before


def test_a_block_that_starts_twice(spark):
    r = resolve(spark, (2026, 11, 1, 1, 30), (2026, 11, 1, 2, 30), "US/Eastern")
    assert r["i"]["start"] == us(2026, 11, 1, 6, 30) and r["i"]["end"] - r["i"]["start"] == 3600 * US and (r["first"], r["last"]) == ("twice", "once")
    over = resolve(spark, (2026, 11, 1, 0, 30), (2026, 11, 1, 3, 30), "US/Eastern")["i"]  # an hour more than the clock says
    assert over["off_by"] == 3600
    assert resolve(spark, (2026, 1, 1), (2026, 1, 1), "UTC")["i"] is None
    assert resolve(spark, (2026, 1, 1, 12), (2026, 1, 1, 13), "Asia/Kolkata")["i"]["start"] == us(2026, 1, 1, 6, 30)


def test_every_hour_of_changing_days(spark):
    rows = []
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "UTC"):
        for day in (date(2026, 3, 29), date(2026, 10, 25), date(2026, 3, 8), date(2026, 11, 1), date(2026, 4, 5), date(2026, 10, 4)):
            rows += [(zone, us(day.year, day.month, day.day) + m * 600 * US) for m in range(144)]
    got = spark.createDataFrame(rows, "zone string, face long").select("zone", "face", C.instants(F.col("face"), F.col("zone")).alias("i"), C.occurs(F.col("face"), F.col("zone")).alias("n")).collect()
    for r in got:
        naive, zone = datetime(1970, 1, 1) + timedelta(microseconds=r["face"]), ZoneInfo(r["zone"])
        both = sorted({int(naive.replace(tzinfo=zone, fold=f).timestamp()) * US for f in (0, 1)})
        real = [t for t in both if datetime.fromtimestamp(t // US, zone).replace(tzinfo=None) == naive]
        assert r["n"] == ("never", "once", "twice")[len(real)] and (r["i"] == real if real else set(both) <= set(r["i"])), r


def test_block_edges(spark):
    week = [{"day": d, "start": "22:00", "end": "06:30"} for d in C.WEEKDAYS]
    odd = [{"day": "XX", "start": "1:00", "end": "2:00"}, {"day": " mo ", "start": "9:05", "end": " 10 : 00 "}, {"day": "TU", "start": "24:00", "end": "2:00"}, {"day": "WE", "end": "2:00"}, {"day": "TH", "start": "x", "end": "2:00"}]
    rows = [(1, "America/New_York", json.dumps(week)), (2, "UTC", json.dumps(odd)), (3, "UTC", "[]"), (4, "UTC", "nonsense"), (5, "UTC", None)]
    start, now = us(2026, 3, 6, 12), us(2026, 3, 10, 12)
    got = sorted((r["schedule_id"], r["edge"], r["us"], r["off_by"]) for r in C.block_edges(spark.createDataFrame(rows, "schedule_id int, zone string, blocks string"), start, now).collect())
    zone, want = ZoneInfo("America/New_York"), [(2, "end", us(2026, 3, 9, 10), 0), (2, "start", us(2026, 3, 9, 9, 5), 0)]
    for k in range(5):
        a = datetime(2026, 3, 6, 22, tzinfo=zone) + timedelta(days=k)
        z = (a.replace(tzinfo=None) + timedelta(hours=8, minutes=30)).replace(tzinfo=zone)
        off = abs(int((z.astimezone(UTC) - a.astimezone(UTC)).total_seconds()) - 30_600)
        want += [(1, e, int(t.timestamp()) * US, off) for e, t in (("start", a), ("end", z)) if start < int(t.timestamp()) * US <= now]
    assert got == sorted(want) and any(w[3] == 3600 for w in want)


def test_end_actions(spark):
    actions = [
        ('[{"type":"output","output_id":" a ","state":"ON"},{"type":"output","output_id":"","state":"on"},{"type":"mail"},{"type":"output","output_id":"b","state":"dim"},{"type":"output","output_id":"c","state":"open"}]', [("a", "off"), ("c", "close")]),
        ('{"type":"output","output_id":"p","state":"start"}', [("p", "stop")]), ("[]", []),
    ]
    got = spark.createDataFrame([(a,) for a, _ in actions], "a string").select(C.end_actions(F.col("a")).alias("e")).collect()
    assert [[tuple(x) for x in r["e"]] for r in got] == [w for _, w in actions]


def loop(rule, start, now):
    """All minutes of the window, one by one, that a rule's parts allow."""
    begin = datetime.strptime(rule["DTSTART"], "%Y%m%dT%H%M%S")
    every, freq = int(rule.get("INTERVAL", 1)), rule["FREQ"]
    numbers = lambda n: [int(x) for x in rule[n].split(",")] if n in rule else None
    months, month_days, hours, minutes = (numbers(n) for n in ("BYMONTH", "BYMONTHDAY", "BYHOUR", "BYMINUTE"))
    days = rule.get("BYDAY", "").split(",") if "BYDAY" in rule else None
    monday = lambda d: d - timedelta(days=d.weekday())
    out, t = [], begin
    while t <= now:
        length = ((t.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)).day
        code = C.WEEKDAYS[t.weekday()]
        names = {code} | ({f"{(t.day - 1) // 7 + 1}{code}", f"-{(length - t.day) // 7 + 1}{code}"} if freq in ("MONTHLY", "YEARLY") else set())
        plain = days is None and month_days is None
        ok = (months is None or t.month in months) and (month_days is None or t.day in month_days or t.day - length - 1 in month_days) and (days is None or names & set(days))
        ok = ok and (t.hour in hours if hours else freq in ("HOURLY", "MINUTELY") or t.hour == begin.hour) and (t.minute in minutes if minutes else freq == "MINUTELY" or t.minute == begin.minute)
        if ok and freq == "MINUTELY":
            ok = int((t - begin).total_seconds()) // 60 % every == 0
        elif ok and freq == "HOURLY":
            ok = int((t.replace(minute=0) - begin.replace(minute=0)).total_seconds()) // 3600 % every == 0
        elif ok and freq == "DAILY":
            ok = (t.date() - begin.date()).days % every == 0
        elif ok and freq == "WEEKLY":
            ok = (monday(t.date()) - monday(begin.date())).days // 7 % every == 0 and (not plain or t.weekday() == begin.weekday())
        elif ok and freq == "MONTHLY":
            ok = (t.year * 12 + t.month - begin.year * 12 - begin.month) % every == 0 and (not plain or t.day == begin.day)
        elif ok and freq == "YEARLY":
            ok = (t.year - begin.year) % every == 0 and (not plain or (t.day == begin.day and (months is not None or t.month == begin.month)))
        if ok and ("UNTIL" not in rule or t <= datetime.strptime(rule["UNTIL"], "%Y%m%dT%H%M%S")):
            out.append(t)
        t += timedelta(minutes=1)
    out = out[: int(rule["COUNT"])] if "COUNT" in rule else out
    return [int(t.replace(tzinfo=UTC).timestamp()) * US for t in out if start < t]


RULES = [
    {"FREQ": "DAILY", "INTERVAL": "3"}, {"FREQ": "DAILY", "BYHOUR": "6,18", "BYMINUTE": "0,30"}, {"FREQ": "WEEKLY"}, {"FREQ": "WEEKLY", "INTERVAL": "2", "BYDAY": "MO,TH,SU"}, {"FREQ": "MONTHLY"}, {"FREQ": "MONTHLY", "BYMONTHDAY": "-1,15"},
    {"FREQ": "MONTHLY", "BYDAY": "2TU,-1FR"}, {"FREQ": "YEARLY", "BYMONTH": "3", "BYDAY": "-1SU"}, {"FREQ": "YEARLY"}, {"FREQ": "HOURLY", "INTERVAL": "7"}, {"FREQ": "MINUTELY", "INTERVAL": "50", "BYHOUR": "3,4"}, {"FREQ": "DAILY", "COUNT": "40"},
    {"FREQ": "HOURLY", "COUNT": "900", "BYDAY": "SA"}, {"FREQ": "DAILY", "UNTIL": "20260310T000000"}, {"FREQ": "DAILY", "BYMONTH": "4"}, {"FREQ": "MONTHLY", "INTERVAL": "2", "BYMONTHDAY": "31"},
]


def test_rules_equal_a_calendar_loop(spark):
    start, now = datetime(2026, 2, 20, 5, 0), datetime(2026, 4, 30, 23, 0)
    rules = [{"DTSTART": "20260131T064500", **r} for r in RULES]
    rows = [(k, f"DTSTART:{r['DTSTART']}Z\nRRULE:" + ";".join(f"{n}={v}" for n, v in r.items() if n != "DTSTART")) for k, r in enumerate(rules)]
    rows += [(100, "nonsense"), (101, None), (102, "DTSTART:20260101T000000Z\nRRULE:FREQ=DAILY;BYSETPOS=1"), (103, "RRULE:FREQ=DAILY"), (104, "DTSTART:20270101T000000Z\nRRULE:FREQ=DAILY")]
    df = spark.createDataFrame(rows, "rule_id int, rule string")
    got = {}
    for r in C.due_times(df, us(2026, 2, 20, 5), us(2026, 4, 30, 23)).collect():
        got.setdefault(r["rule_id"], []).append(r["due"])
    want = {k: w for k, r in enumerate(rules) if (w := loop(r, start, now))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) >= 13
    assert C.due_times(df, us(2026, 2, 20, 5), us(2026, 2, 20, 5)).count() == 0


def test_rules_of_a_zone_and_of_seconds(spark):
    rows = [(1, "DTSTART;TZID=America/New_York:20260301T080000\nRRULE:FREQ=DAILY"), (2, "DTSTART:20260307T115955Z\nRRULE:FREQ=SECONDLY;INTERVAL=4"), (3, "DTSTART:20260307\nRRULE:FREQ=DAILY;BYHOUR=12;BYSECOND=1,2")]
    got = sorted((r["rule_id"], r["due"]) for r in C.due_times(spark.createDataFrame(rows, "rule_id int, rule string"), us(2026, 3, 7, 12), us(2026, 3, 7, 12, 0, 10)).collect())
    assert got == [(2, us(2026, 3, 7, 12, 0, 3)), (2, us(2026, 3, 7, 12, 0, 7)), (3, us(2026, 3, 7, 12, 0, 1)), (3, us(2026, 3, 7, 12, 0, 2))]
    got = sorted(r["due"] for r in C.due_times(spark.createDataFrame(rows[:1], "rule_id int, rule string"), us(2026, 3, 7, 12), us(2026, 3, 9, 13)).collect())
    assert got == [us(2026, 3, 7, 13), us(2026, 3, 8, 12), us(2026, 3, 9, 12)]  # the clocks have changed


def test_edges_of_many_schedules_that_share_their_blocks(spark):
    """Instants are found once for each clock face; when each schedule found its own, these took minutes."""
    import time

    blocks = F.concat(F.lit('[{"day": "SU", "start": "0'), (F.col("id") % 3).cast("string"), F.lit(':30", "end": "05:00"}]'))
    many = spark.range(60_000).select(F.col("id").alias("schedule_id"), F.lit("Europe/Berlin").alias("zone"), blocks.alias("blocks"))
    began = time.monotonic()
    window = (1_709_856_000 * US, 1_712_534_400 * US)
    got = C.block_edges(many, *window).groupBy((F.col("schedule_id") % 3).alias("k"), "day", "edge", "us", "off_by").count().collect()
    assert time.monotonic() - began < 40
    few = C.block_edges(many.where("schedule_id < 3"), *window).collect()
    assert sorted((r["k"], r["day"], r["edge"], r["us"], r["off_by"], r["count"]) for r in got) == sorted((*r, 20_000) for r in few) and len(few) == 30


def test_due_times_of_many_ids_that_share_their_rules(spark):
    """Each set of texts is followed once; an id with two rules is due at the times of both."""
    import time

    k = F.col("id")
    text = F.concat(F.lit("DTSTART:20260101T0"), (k % 3).cast("string"), F.lit("0000Z\nRRULE:FREQ=HOURLY;INTERVAL=5"))
    many = spark.range(400_000).select(k.alias("rule_id"), text.alias("rule"))
    more = spark.createDataFrame([(-1, "DTSTART:20260101T000000Z\nRRULE:FREQ=DAILY"), (-1, "DTSTART:20260101T000000Z\nRRULE:FREQ=DAILY;INTERVAL=2"), (-1, None), (-2, None)], "rule_id long, rule string")
    began = time.monotonic()
    window = (us(2026, 1, 10), us(2026, 1, 30))
    got = C.due_times(many.unionByName(more), *window).groupBy(F.when(F.col("rule_id") < 0, -1).otherwise(F.col("rule_id") % 3).alias("k"), "due").count().collect()
    assert time.monotonic() - began < 40
    want = [(-1, us(2026, 1, d), 1) for d in range(11, 31)]
    want += [(j, t, len(range(j, 400_000, 3))) for j in range(3) for t in range(us(2026, 1, 1, j), window[1] + 1, 5 * 3600 * US) if t > window[0]]
    assert sorted(map(tuple, got)) == sorted(want)
