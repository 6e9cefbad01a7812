"""The lake's manifest: what is scanned, atomic rewrites, tiers, replication."""

import pytest
from pyspark.sql import functions as F

from tidewell.model import US
from tidewell.sources.manifest import COLD, HOT, Day, Lake, Manifest

DAY = 86_400 * US
POINTS = "sensor_id string, us long, value double, quality int, inserted_at long"
START = 1_767_225_600 * US  # 2026-01-01


def points(spark, days, sensors=("a", "b", "c", "d", "e"), each=3, inserted=0, value=0.0):
    rows = [(s, START + d * DAY + i * 1000 * US, value + d + i, 0, START + d * DAY + inserted) for d in days for s in sensors for i in range(each)]
    return spark.createDataFrame(rows, POINTS)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/hot", f"file://{tmp_path}/cold", shards=4, retention_days=30)


def test_scan_lists_the_days_and_shards_of_its_range(spark, lake):
    lake.append(points(spark, range(4)), START + 4 * DAY)
    found = lake.partitions(START, START + DAY - 1, ["a"])
    assert len(found) == 1 and "date=2026-01-01" in found[0][1]
    assert {p.split("date=")[1][:10] for _, p in lake.partitions(START + DAY, START + 2 * DAY)} == {"2026-01-02", "2026-01-03"}
    got = lake.read(START + DAY, START + 2 * DAY, [" a ", "b"])
    assert sorted((r["sensor_id"], (r["us"] - START) // DAY) for r in got.collect()) == sorted([(s, d) for s in "ab" for d in (1, 1, 1, 2)])
    assert all("date=2026-01-0" in f for f in got.inputFiles()) and not any("2026-01-04" in f or "2026-01-01" in f for f in got.inputFiles())
    assert lake.partitions(START + 1, START) == [] and lake.read(START, START, []).count() == lake.read(0, 1).count() == 0


def test_the_manifest_decides_the_tier(spark, lake, tmp_path):
    day = points(spark, [2])
    lake.append(day, START)
    Lake(spark, lake.cold, None, 4).append(day.withColumn("value", F.lit(7.0)), START)  # the other tier has that day too
    at = START + 2 * DAY
    assert lake.read(at, at + DAY - 1).agg(F.max("value")).first()[0] == 4.0
    lake.commit(lake.manifest(), {"2026-01-03": Day(COLD)})
    assert lake.read(at, at + DAY - 1).agg(F.min("value"), F.max("value")).first()[:] == (7.0, 7.0)
    # What is not in its own tier is read from the other.
    lake._delete(f"{lake.cold}/date=2026-01-03")
    assert lake.read(at, at + DAY - 1).agg(F.max("value")).first()[0] == 4.0


def test_location_without_a_cold_tier_and_by_age(spark, lake, tmp_path):
    m = Manifest(days={"2026-01-04": Day(COLD)})
    assert lake.location(m, "2026-01-04", START) == COLD
    assert Lake(spark, lake.hot, None).location(m, "2026-01-04", START) == HOT
    now = START + 34 * DAY
    assert lake.location(Manifest(), "2026-01-01", now) == COLD and lake.location(Manifest(), "2026-02-03", now) == HOT


def test_rewrites_swap_whole_days(spark, lake):
    for k in range(3):
        lake.append(points(spark, [0, 1], inserted=k, value=10.0 * k), START + DAY)
    before = lake.read(START, START + DAY)  # planned before, read after
    assert lake.compact(START + 5 * DAY, more_than=2) == ["2026-01-01", "2026-01-02"]
    m = lake.manifest()
    assert all(d.compacted_us == START + 5 * DAY and d.files <= 4 for d in m.days.values()) and m.version == 4
    assert lake.compact(START + 6 * DAY, more_than=2) == [] and lake.manifest().version == 4
    want = sorted((s, START + d * DAY + i * 1000 * US, 20.0 + d + i) for d in (0, 1) for s in "abcde" for i in range(3))
    now = lake.read(START, START + 2 * DAY)
    assert sorted((r["sensor_id"], r["us"], r["value"]) for r in now.collect()) == want
    assert before.count() == len([w for w in want if w[1] <= START + DAY])
    # A backfill drops what the source has not; late points go where the day lies.
    lake.backfill(points(spark, [0], sensors=("a",), each=2, value=50.0), "2026-01-01", START + 6 * DAY)
    lake.append(points(spark, [0], sensors=("z",), each=1), START + 6 * DAY)
    assert sorted((r["sensor_id"], r["value"]) for r in lake.read(START, START + DAY - 1).collect()) == [("a", 50.0), ("a", 51.0), ("z", 0.0)]
    lake.backfill(points(spark, [9]), "2026-01-01", START + 7 * DAY)  # nothing left of that day
    assert lake.read(START, START + DAY - 1).count() == 0 and lake.read(START + DAY, START + 2 * DAY - 1).count() == 15
    gone = lake.vacuum()
    assert len(gone) >= 3 and lake.vacuum() == [] and lake.read(START + DAY, START + 2 * DAY - 1).count() == 15


def test_old_days_move_to_the_cold_tier(spark, lake):
    lake.append(points(spark, [0, 1, 40]), START + 40 * DAY)
    assert lake.retain(START + 41 * DAY) == ["2026-01-01", "2026-01-02"] and lake.retain(START + 41 * DAY) == []
    m = lake.manifest()
    assert [m.days[d].location for d in sorted(m.days)] == [COLD, COLD, HOT]
    lake.vacuum()
    assert lake._names(f"{lake.hot}/date=*")[0].endswith("date=2026-02-10") and lake.read(START, START + 41 * DAY).count() == 45
    lake.append(points(spark, [0], sensors=("late",)), START + 41 * DAY)  # goes to the cold tier, where the day is
    assert lake.read(START, START + DAY - 1).count() == 18


def test_only_one_writer_makes_a_version(spark, lake):
    lake.append(points(spark, [0]), START)
    old = lake.manifest()
    lake.commit(old, {"2026-01-05": Day(HOT)})
    with pytest.raises(FileExistsError, match="version 2"):
        lake.commit(old, {"2026-01-06": Day(HOT)})
    assert set(lake.manifest().days) == {"2026-01-01", "2026-01-05"} and not lake._names(f"{lake.hot}/_manifest/new-*")


def test_replication_follows_the_watermark(spark, lake):
    source = points(spark, [0, 1, 2], inserted=3600 * US)
    lake.replicate(source, START + DAY)
    assert lake.manifest().watermark_us == START + DAY - 60 * US and lake.read(START, START + 3 * DAY).count() == 15
    lake.replicate(source, START + DAY)  # again: nothing new
    lake.replicate(source, START + 2 * DAY)
    assert lake.read(START, START + 3 * DAY, dedupe=False).count() == 30
    with pytest.warns(UserWarning, match="wait for a backfill"):
        lake.replicate(source, START + 9 * DAY)
    assert lake.read(START, START + 3 * DAY).count() == 30
    lake.backfill(source, "2026-01-03", START + 9 * DAY)
    assert lake.read(START, START + 3 * DAY).count() == 45
