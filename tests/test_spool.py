"""Spool segments: round trip, broken tails, replay."""

import numpy as np
import pytest

from tidewell.sources import spool

A, B = "00000000-0000-0000-0000-00000000000a", "123e4567-e89b-12d3-a456-426614174000"


def samples(n, start=1):
    rng = np.random.default_rng(n)
    return {"sensor_idx": rng.integers(0, 5, n), "seq": np.arange(start, start + n), "ms": rng.integers(0, 2**40, n), "value": rng.normal(size=n), "quality": rng.integers(-3, 3, n), "time_quality": rng.integers(0, 3, n), "monotonic_ms": rng.integers(0, 2**40, n)}


def test_checksum_of_known_bytes():
    assert spool.checksums(np.frombuffer(b"123456789", np.uint8)[None, :]).tolist() == [0xE3069283]  # the check value of CRC-32C
    assert spool.checksums(np.zeros((1, 32), np.uint8)).tolist() == [0x8A9136AA]


def test_a_broken_tail_is_cut():
    whole = spool.encode(B, samples(9, 100))
    stream, start, frames = spool.decode(whole)
    assert (stream, start, frames["seq"].tolist()) == (B, 100, list(range(100, 109)))
    assert len(spool.decode(whole[:-1])[2]) == 8 and len(spool.decode(whole + b"\x28\0\0\0torn")[2]) == 9 and len(spool.decode(whole + bytes(48))[2]) == 9
    bad = bytearray(whole)
    bad[64 + 3 * 48 + 20] ^= 1  # a bit of the fourth sample: nothing after it counts
    assert spool.decode(bytes(bad))[2]["seq"].tolist() == [100, 101, 102]
    assert spool.decode(whole[:63]) is None and spool.decode(b"x" * 200) is None and len(spool.decode(whole[:64])[2]) == 0


def test_round_trip_and_replay(spark, tmp_path):
    rows = []
    for stream, n in ((A, 700), (B, 50)):
        s = samples(n)
        rows += [(stream, *(v[i].item() for v in s.values())) for i in range(n)]
    names = "stream_id string, sensor_idx long, seq long, ms long, value double, quality int, time_quality int, monotonic_ms long"
    df = spark.createDataFrame(rows, names)
    spool.write_spool(df, f"{tmp_path}/spool", max_samples=300)
    assert len(list((tmp_path / "spool").glob("seg-*.seg"))) >= 4 and not list((tmp_path / "spool").glob(".*.seg.*"))
    # An open segment that repeats a sample and ends in the middle of one; files of other kinds; an empty one.
    (tmp_path / f"spool/seg-{B}-50.open").write_bytes(spool.encode(B, samples(3, 50))[:-5])
    (tmp_path / "spool/sensors.json").write_text("{}")
    (tmp_path / f"spool/seg-{A}-900.open").write_bytes(b"")
    got = spool.read_spool(spark, f"file://{tmp_path}/spool")
    kept = [c.split()[0] for c in names.split(", ")]
    assert sorted(tuple(r[c] for c in kept) for r in got.where("seq <= 50 or stream_id like '%a'").collect() if not (r["seq"] == 50 and r["start_seq"] == 50)) == sorted(rows)
    acked = spark.createDataFrame([(A, 690), (None, 5)], "stream_id string, acked long")
    left = sorted((r["stream_id"], r["seq"]) for r in spool.replay(got, acked).collect())
    assert left == sorted([(A, k) for k in range(691, 701)] + [(B, k) for k in range(1, 52)])
    assert got.rdd.getNumPartitions() == len(list((tmp_path / "spool").glob("seg-*")))
    assert spool.read_spool(spark, f"{tmp_path}/nothing").count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_small_segments(n):
    assert len(spool.decode(spool.encode(A, samples(n)))[2]) == n
