"""The unified ranking: tiers with support, stability over thirds, dependency paths, odd inputs."""

import pytest

from tidewell.operators import unified as U

H = 3600


@pytest.fixture(scope="module")
def events(spark):
    """twin has the focus's events an hour later; weak shares one; busy has many; late only the last third's."""
    at = [0, 10, 20, 40, 55, 70, 88]
    rows = [("focus", t * H, 5.0) for t in at] + [("twin", (t + 1) * H, 5.0) for t in at] + [("weak", 10 * H, 1.0), ("weak", 33 * H, 1.0)] + [("busy", t * H, 4.0) for t in range(90)] + [("late", t * H, -5.0) for t in (70, 88)]
    return spark.createDataFrame(rows, "sensor_id string, bucket long, z double")


@pytest.fixture(scope="module")
def changes(spark):
    rows = [("focus", t * H, float((t * 7) % 11)) for t in range(90)] + [("twin", (t + 1) * H, -2.0 * ((t * 7) % 11)) for t in range(90)]
    return spark.createDataFrame(rows, "sensor_id string, bucket long, delta double")


def related(events, changes, how, **options):
    out = U.related(events, changes, "focus", 0, 90 * H, [-H, 0, H], how, **options)
    return {r["candidate"]: r for r in out.collect()}


def test_evidence_tiers_and_paths(spark, events, changes):
    edges = spark.createDataFrame([("twin", "middle"), ("middle", "focus"), ("busy", "other")], "node string, input string")
    got = related(events, changes, U.Ranking(0.6, 0.3, 0.1, include_low=True), edges=edges)
    twin = got["twin"]
    assert (twin["rank"], twin["lag"], twin["score"], twin["overlap"], twin["agreement"]) == (1, H, 1.0, 7, 1.0) and twin["delta_corr"] == pytest.approx(-1.0) and twin["shared"] is None
    assert twin["path"] == ["twin", "middle", "focus"] and got["busy"]["path"] is None and twin["blend"] == pytest.approx(0.7) and twin["tier"] == "medium"
    assert got["busy"]["penalty"] == pytest.approx((7 / 90) ** 0.5) and got["busy"]["shared"] == 7 and got["busy"]["average"] == 20.0
    assert got["late"]["delta_corr"] is None and got["late"]["blend"] == pytest.approx(0.6 * got["late"]["score"] + 0.3)  # no change, nothing of its weight
    assert got["late"]["shared"] == 2 and got["late"]["average"] == 25.0 and got["late"]["agreement"] == 0.0
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4]


def test_low_tiers_strip_and_limits(events, changes):
    some = related(events, changes, U.Ranking(0.6, 0.4))
    assert "weak" not in some and all(r["tier"] != "low" for r in some.values())
    assert len(related(events, changes, U.Ranking(include_low=True, results=2))) == 2
    # Buckets in which half of the sensors have events do not count as shared: what is left of busy's are those it has alone with the focus.
    calm = related(events, changes, U.Ranking(include_low=True, strip_system_wide=True))
    assert calm["late"]["shared"] is None and calm["busy"]["shared"] == 4


def test_stability(spark, events, changes):
    got = related(events, changes, U.Ranking(include_low=True))
    # Of ten places, the thirds fill 3 (twin, weak, busy), 2 (twin, busy) and 3 (twin, busy, late); weak's other event is matched by none.
    assert all(r["stability"] == pytest.approx(8 / 30) and r["stability_tier"] == "low" for r in got.values())
    ranks = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, "b", 1), (3, "a", 1)], "part int, candidate string, rank int")
    assert U.stability(ranks, 5, top=1).first()[:] == (pytest.approx(2 / 3), "medium") and U.stability(ranks, 121).first()[:] == (None, None)


def test_nothing_related(spark, events, changes):
    assert related(events.where("sensor_id = 'focus'"), changes, U.Ranking(include_low=True)) == {}
    assert related(events.limit(0), changes.limit(0), U.Ranking(include_low=True)) == {}
