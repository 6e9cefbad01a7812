"""Local time, weekly blocks and recurrence rules, as columns and explodes.

A local time is the microseconds that its clock face would be in UTC. Where clocks are set back it stands for two instants, and
where they are set forward for none; a block's edges are then chosen together, so that it lasts as long as it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.model import US

MINUTE, HOUR, DAY = 60 * US, 3600 * US, 86_400 * US
_EPOCH = "1970-01-01 00:00:00"
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def _ntz(us: Column) -> Column:
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / F.lit(US)).cast("decimal(18,6)"))


def _face(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), ntz)


def local_face(us: Column, zone: Column) -> Column:
    """The clock face of ``zone`` at an instant."""
    return _face(F.convert_timezone(F.lit("UTC"), zone, _ntz(us)))


def date_of_face(face: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(face / DAY).cast("int"))


def face_of_date(day: Column) -> Column:
    return F.unix_date(day).cast("long") * DAY


def instants(face: Column, zone: Column, search_minutes: int = 180) -> Column:
    """The instants that a local time may stand for, in order: one; both, where it occurs twice; where it does not
    occur, the next minute that does, and what the offsets before and after the jump would make of it.

    Offsets are taken a day before and a day after, so no more than one change a day is looked for.
    """
    offset = lambda us: local_face(us, zone) - us
    before, after = face - offset(face - DAY), face - offset(face + DAY)
    is_at = lambda us, f: local_face(us, zone) == f
    both = F.array_sort(F.array_distinct(F.filter(F.array(before, after), lambda c: is_at(c, face))))
    later = F.transform(F.sequence(F.lit(1), F.lit(search_minutes)), lambda m: face + m.cast("long") * MINUTE)
    # A later time in the gap's day has the offset after the jump.
    shift = face - after
    next_valid = F.get(F.filter(later, lambda f: is_at(f - shift, f)), F.lit(0)) - shift
    gap = F.array_sort(F.array_distinct(F.array_compact(F.array(next_valid, before, after))))
    return F.when(F.size(both) > 0, both).otherwise(gap)


def occurs(face: Column, zone: Column) -> Column:
    """``once``, ``twice`` or ``never``: how often a local time occurs."""
    offset = lambda us: local_face(us, zone) - us
    both = F.array_distinct(F.filter(F.array(face - offset(face - DAY), face - offset(face + DAY)), lambda c: local_face(c, zone) == face))
    return F.when(F.size(both) == 0, "never").when(F.size(both) == 1, "once").otherwise("twice")


def nearest_pair(starts: Column, ends: Column, length: Column) -> Column:
    """struct(off_by, start, end): of two arrays of instants the pair in order whose distance is nearest to ``length`` (ties: the
    earliest), and by how many seconds it differs; null if no pair is in order."""
    pairs = F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.struct((F.abs((e - s) - length) / US).cast("long").alias("off_by"), s.alias("start"), e.alias("end")))))
    return F.array_min(F.filter(pairs, lambda p: p["end"] > p["start"]))


def block_instants(start: Column, end: Column, zone: Column) -> Column:
    """struct(start, end, off_by) of ``nearest_pair`` for the clock faces of a block; null if the end is not after the start."""
    best = nearest_pair(instants(start, zone), instants(end, zone), end - start)
    return F.when(end > start, F.struct(best["start"].alias("start"), best["end"].alias("end"), best["off_by"].alias("off_by")))


_BLOCKS = "array<struct<day: string, start: string, end: string>>"
#: The state that a block's end puts an output in.
_ENDS = {"on": "off", "off": "off", "open": "close", "close": "close", "start": "stop", "stop": "stop"}


def _clock(text: Column) -> Column:
    """Microseconds of the day of ``HH:MM``; null if it is none."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{1,3})\s*:\s*(\d{1,3})\s*$", k).try_cast("int")
    hour, minute = part(1), part(2)
    return F.when((hour <= 23) & (minute <= 59), (hour * 60 + minute).cast("long") * MINUTE)


def block_edges(schedules: DataFrame, start_us: int, now_us: int) -> DataFrame:
    """schedule_id, day, edge (start or end), us, off_by of those block edges in (start, now] of
    ``schedules(schedule_id, zone, blocks)``; blocks: a JSON array of {"day": "MO", "start": "HH:MM", "end": "HH:MM"}.

    A block whose end is not after its start ends on the next day. The blocks of each local day from that of the
    window's start to that of its end are looked at. Blocks that can't be read, and texts that are no array, have no edges.
    Schedules share their clock faces, so the instants of each face of a zone are found once and joined.
    """
    zone = F.col("zone")
    low, high = (date_of_face(local_face(F.lit(us).cast("long"), zone)) for us in (start_us, now_us))
    every = schedules.select("schedule_id", "zone", F.explode(F.from_json("blocks", _BLOCKS)).alias("b"), low.alias("low"), high.alias("high"))
    place = F.array_position(F.array(*(F.lit(d) for d in WEEKDAYS)), F.upper(F.trim("b.day"))).cast("int") - 1
    first_day = F.date_add("low", F.pmod(place - F.weekday("low"), F.lit(7)))
    read = every.where(place >= 0).select("schedule_id", "zone", _clock(F.col("b.start")).alias("a"), _clock(F.col("b.end")).alias("z"), first_day.alias("day"), "high").where("a is not null and z is not null and day <= high")
    today = read.select("schedule_id", "zone", "a", "z", F.explode(F.sequence("day", "high", F.expr("interval 7 days"))).alias("day"))
    first = face_of_date(F.col("day")) + F.col("a")
    last = face_of_date(F.col("day")) + F.col("z") + F.when(F.col("z") <= F.col("a"), F.lit(DAY)).otherwise(0)
    blocks = today.select("schedule_id", "zone", "day", first.alias("first"), last.alias("last"))
    faces = blocks.select("zone", F.explode(F.array("first", "last")).alias("face")).distinct().select("zone", "face", instants(F.col("face"), zone).alias("at"))
    of = lambda name, at: faces.select("zone", F.col("face").alias(name), F.col("at").alias(at))
    paired = blocks.join(of("first", "_starts"), ["zone", "first"]).join(of("last", "_ends"), ["zone", "last"])
    found = paired.select("schedule_id", "day", nearest_pair(F.col("_starts"), F.col("_ends"), F.col("last") - F.col("first")).alias("i")).where("i is not null")
    edges = found.select("schedule_id", "day", "i.off_by", F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("i.start").alias("us")), F.struct(F.lit("end").alias("edge"), F.col("i.end").alias("us")))).alias("e"))
    return edges.select("schedule_id", "day", "e.edge", "e.us", "off_by").where((F.col("us") > start_us) & (F.col("us") <= now_us))


def end_actions(actions: Column) -> Column:
    """What a block's end does, of a JSON action or array of actions: outputs with a known state get the state at rest."""
    one = "struct<type: string, output_id: string, state: string>"
    items = F.when(F.trim(actions).startswith("["), F.from_json(actions, f"array<{one}>")).otherwise(F.array(F.from_json(actions, one)))
    state = lambda a: F.lower(F.trim(a["state"]))
    rest = F.create_map(*(F.lit(x) for pair in _ENDS.items() for x in pair))
    outputs = F.filter(items, lambda a: (a["type"] == "output") & (F.trim(F.coalesce(a["output_id"], F.lit(""))) != "") & state(a).isin(*_ENDS))
    return F.transform(outputs, lambda a: F.struct(F.trim(a["output_id"]).alias("output_id"), F.element_at(rest, state(a)).alias("state")))


# ---- recurrence rules ---------------------------------------------------------------------


def _field(rule: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(rule, rf"(?:^|[;:\n]){name}=([^;\s]+)", 1), F.lit(""))


def _numbers(rule: Column, name: str) -> Column:
    """The whole numbers of a list; null if there is none."""
    return F.transform(F.split(_field(rule, name), ","), lambda x: x.try_cast("int"))


def parsed(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """``rules`` with the fields of ``DTSTART:...Z`` (or with ``;TZID=zone:``) and ``RRULE:FREQ=...``; rows that can't be read,
    or ask for BYSETPOS, BYYEARDAY or BYWEEKNO, are left out."""
    text = F.upper(F.col(rule))
    stamp = lambda s: _face(F.try_to_timestamp(F.rpad(F.regexp_replace(F.upper(s), "[TZ]", ""), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))
    start = F.regexp_extract(text, r"DTSTART[^:\n]*:(\d{8}(?:T\d{6})?Z?)", 1)
    out = rules.select(
        "*", _field(text, "FREQ").alias("_freq"), F.coalesce(_field(text, "INTERVAL").try_cast("int"), F.lit(1)).alias("_every"), _field(text, "COUNT").try_cast("int").alias("_count"),
        stamp(F.nullif(_field(text, "UNTIL"), F.lit(""))).alias("_until"), stamp(F.nullif(start, F.lit(""))).alias("_start"), F.coalesce(F.nullif(F.regexp_extract(F.col(rule), r"(?i)TZID=([^:;\s]+)", 1), F.lit("")), F.lit("UTC")).alias("_zone"),
        F.split(_field(text, "BYDAY"), ",").alias("_days"), *(_numbers(text, f"BY{n}").alias(f"_{n.lower()}s") for n in ("MONTH", "MONTHDAY", "HOUR", "MINUTE", "SECOND")), F.coalesce(_field(text, "WKST"), F.lit("MO")).alias("_wkst"),
    )
    return out.where(F.col("_freq").isin("YEARLY", "MONTHLY", "WEEKLY", "DAILY", "HOURLY", "MINUTELY", "SECONDLY") & F.col("_start").isNotNull() & (F.col("_every") >= 1) & ~text.rlike("BYSETPOS|BYYEARDAY|BYWEEKNO"))


def _day_fits() -> Column:
    """Is ``_day`` one of the days of its rule?"""
    c, day = F.col, F.col("_day")
    first = date_of_face(c("_start"))
    freq = c("_freq")
    weekday = F.element_at(F.array(*(F.lit(d) for d in WEEKDAYS)), F.weekday(day) + 1)
    of_month, length = F.dayofmonth(day), F.dayofmonth(F.last_day(day))
    # A weekday with a number is that one of the month, or of the year in a yearly rule without months.
    yearly = (freq == "YEARLY") & c("_months").isNull()
    place, rest = F.when(yearly, F.dayofyear(day)).otherwise(of_month), F.when(yearly, F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) - F.dayofyear(day)).otherwise(length - of_month)
    nth, from_end = F.concat(F.floor((place - 1) / 7) + 1, weekday), F.concat(F.lit("-"), F.floor(rest / 7) + 1, weekday)
    any_day = c("_days").isNull() | F.array_contains("_days", weekday) | (freq.isin("MONTHLY", "YEARLY") & (F.array_contains("_days", nth) | F.array_contains("_days", F.concat(F.lit("+"), nth)) | F.array_contains("_days", from_end)))
    any_month_day = c("_monthdays").isNull() | F.array_contains("_monthdays", of_month) | F.array_contains("_monthdays", of_month - length - 1)
    any_month = c("_months").isNull() | F.array_contains("_months", F.month(day))
    plain = c("_days").isNull() & c("_monthdays").isNull()
    index = F.array_position(F.array(*(F.lit(d) for d in WEEKDAYS)), c("_wkst")).cast("int") - 1
    week = lambda d: F.floor((F.unix_date(d) + 3 - index) / 7)  # noqa: E731  weeks that begin with WKST
    months = lambda d: F.year(d) * 12 + F.month(d)
    fits = (
        F.when(freq == "DAILY", (F.datediff(day, first) % c("_every")) == 0)
        .when(freq == "WEEKLY", ((week(day) - week(first)) % c("_every") == 0) & (~plain | (F.weekday(day) == F.weekday(first))))
        .when(freq == "MONTHLY", ((months(day) - months(first)) % c("_every") == 0) & (~plain | (of_month == F.dayofmonth(first))))
        .when(freq == "YEARLY", ((F.year(day) - F.year(first)) % c("_every") == 0) & (~plain | ((of_month == F.dayofmonth(first)) & (c("_months").isNotNull() | (F.month(day) == F.month(first))))))
        .otherwise(True)
    )
    return any_day & any_month_day & any_month & fits


def due_times(rules: DataFrame, start_us: int, now_us: int, rule: str = "rule") -> DataFrame:
    """rule_id, due: the instants in (start, now] at which each of ``rules(rule_id, rule)`` recurs.

    Days of the window are exploded and filtered first, then hours, minutes and seconds; a rule with COUNT is followed from
    its start. Local times of a rule with TZID that a zone skips or repeats go where Spark puts them. Ids share their
    rules: each set of texts that an id has is followed once, and what is due by it joined.
    """
    c = F.col
    ids = rules.where(c(rule).isNotNull()).groupBy("rule_id").agg(F.array_sort(F.collect_set(rule)).alias("_set"))
    p = parsed(ids.select("_set").distinct().select("_set", F.explode("_set").alias(rule)), rule)
    low = F.when(c("_count").isNotNull(), c("_start") - 1).otherwise(F.greatest(c("_start") - 1, local_face(F.lit(start_us).cast("long"), c("_zone"))))
    high = F.least(local_face(F.lit(now_us).cast("long"), c("_zone")), F.coalesce("_until", F.lit(1 << 62)))
    p = p.withColumn("_low", low).withColumn("_high", high).where("_low < _high")
    days = p.withColumn("_day", F.explode(F.sequence(date_of_face(c("_low")), date_of_face(c("_high"))))).where(_day_fits())
    begin = c("_start")
    fine = {"HOURLY": 1, "MINUTELY": 2, "SECONDLY": 3}
    level = F.coalesce(*(F.when(c("_freq") == f, n) for f, n in fine.items()), F.lit(0))
    of_start = lambda unit, n: F.pmod(F.floor(begin / unit), F.lit(n)).cast("int")
    face, steps = face_of_date(c("_day")), days
    for k, (name, unit, n) in enumerate((("_hours", HOUR, 24), ("_minutes", MINUTE, 60), ("_seconds", US, 60)), 1):
        choices = F.coalesce(name, F.when(level >= k, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(of_start(unit, n))))
        face = (face if k == 1 else c("_face")) + c("_x").cast("long") * unit
        steps = steps.withColumn("_x", F.explode(choices)).where(c("_x").between(0, n - 1)).withColumn("_face", face).drop("_x")
        whole = F.floor(c("_face") / unit) - F.floor(begin / unit)
        # Within the window, as far as this unit tells, and on the rule's interval if this is its unit.
        steps = steps.where((c("_face") + unit > c("_low")) & (c("_face") <= c("_high")) & ((level != k) | (whole % c("_every") == 0)))
    found = steps.where((c("_face") > c("_low")) & (c("_face") >= begin))
    due = _face(F.convert_timezone(c("_zone"), F.lit("UTC"), _ntz(c("_face"))))
    found = found.select("_set", due.alias("due"), "_count").distinct()
    # COUNT bounds the rows of these rules, up to the window's end.
    k = F.row_number().over(Window.partitionBy("_set").orderBy("due"))
    counted = found.where(c("_count").isNotNull()).withColumn("_k", k).where("_k <= _count").drop("_k")
    found = found.where(c("_count").isNull()).unionByName(counted).where((c("due") > start_us) & (c("due") <= now_us))
    return ids.join(found, "_set").select("rule_id", "due")
