"""The lake with a manifest: which tier and folder holds each day, swapped as a whole.

A lake has a hot and maybe a cold root. A manifest holds a row for each day (tier, folder, number of files, time of its
last compaction) and the watermark of replication; it is a small Parquet table in ``_manifest``, and a change is a new version
that is renamed into place, which fails if another writer was first. Whatever rewrites a day (compaction, backfill, retention)
writes a folder of its own and then swaps the manifest, so a reader sees the day as it was or as it is, never both.
``vacuum`` removes the folders that no day refers to.

A scan lists the days of its range only, once for each tier. The driver holds a row for each day, and the names
of the partitions in the range; no rows of the lake.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import US
from tidewell.sources.lake import LAKE, SHARDS, last_ingested, shard_of_value, with_partitions

HOT, COLD = "hot", "cold"
_TABLE = "date string, location string, folder string, files long, compacted_us long, updated_us long, watermark_us long"
_POINTS = "sensor_id", "us", "value", "quality", "inserted_at", "date", "shard"


@dataclass(frozen=True)
class Day:
    location: str
    folder: str = ""
    files: int | None = None
    compacted_us: int | None = None
    updated_us: int | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    days: dict[str, Day] = field(default_factory=dict)
    watermark_us: int | None = None


def day_of(us: int) -> str:
    return datetime.fromtimestamp(us // US, UTC).strftime("%Y-%m-%d")


def days_between(start_us: int, end_us: int) -> list[str]:
    """The days of [start, end]; none if it is empty."""
    if end_us < start_us:
        return []
    first, last = (date.fromisoformat(day_of(t)) for t in (start_us, end_us))
    return [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]


@dataclass
class Lake:
    spark: SparkSession
    hot: str
    cold: str | None = None
    shards: int = SHARDS
    retention_days: int = 90

    # ---- files ------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, pattern: str) -> list[str]:
        """The paths that a pattern matches, in order."""
        fs, at = self._fs(pattern)
        found = fs.globStatus(at)
        return sorted(s.getPath().toString() for s in found) if found is not None else []

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        if not fs.delete(at, True) and fs.exists(at):
            raise OSError(f"{path} could not be removed")

    def _root(self, location: str, folder: str = "") -> str:
        base = (self.cold if location == COLD else self.hot).rstrip("/")
        return f"{base}/{folder}" if folder else base

    # ---- manifest ---------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        """The newest version; without one, nothing is known of any day."""
        versions = self._names(f"{self._root(HOT)}/_manifest/v=*")
        if not versions:
            return Manifest()
        days, watermark = {}, None
        for r in self.spark.read.schema(_TABLE).parquet(versions[-1]).collect():  # a row for each day
            if r["date"] is None:
                watermark = r["watermark_us"]
            else:
                days[r["date"]] = Day(r["location"], r["folder"] or "", r["files"], r["compacted_us"], r["updated_us"])
        return Manifest(int(versions[-1].rsplit("=", 1)[1]), days, watermark)

    def commit(self, old: Manifest, days: dict[str, Day], watermark_us: int | None = None) -> Manifest:
        """``old`` with these days, as its next version; FileExistsError if another writer has made that."""
        new = Manifest(old.version + 1, {**old.days, **days}, old.watermark_us if watermark_us is None else watermark_us)
        rows = [(d, x.location, x.folder, x.files, x.compacted_us, x.updated_us, None) for d, x in sorted(new.days.items())] + [(None, None, None, None, None, None, new.watermark_us)]
        root = f"{self._root(HOT)}/_manifest"
        written = f"{root}/new-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _TABLE).coalesce(1).write.parquet(written)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, source = self._fs(written)
        _, target = self._fs(f"{root}/v={new.version:012d}")
        try:  # fails if the target is there
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            self._delete(written)
            if "FileAlreadyExists" in str(error):
                raise FileExistsError(f"version {new.version} of the manifest has been written by another") from error
            raise
        return new

    def location(self, manifest: Manifest, day: str, now_us: int) -> str:
        """The tier of a day: as the manifest says; else by age, where there is a cold tier."""
        known = manifest.days.get(day)
        if known and (known.location == HOT or (known.location == COLD and self.cold)):
            return known.location
        return COLD if self.cold and day < day_of(now_us - self.retention_days * 86_400 * US) else HOT

    # ---- reading ----------------------------------------------------------------------------

    def partitions(self, start_us: int, end_us: int, sensors: list[str] | None = None, manifest: Manifest | None = None) -> list[tuple[str, str]]:
        """(base, folder of a date and shard) of [start, end] and the sensors' shards, in order.

        A day is where the manifest says; a partition that is not there is looked for in the other tier.
        """
        manifest = manifest or self.manifest()
        wanted = None
        if sensors is not None:
            names = sorted({s.strip() for s in sensors if s.strip()})
            found = self.spark.range(1).select(F.array(*(shard_of_value(s, self.shards) for s in names)).alias("s")).first()["s"] if names else []
            wanted = {f"shard={s}" for s in found}
        asked = days_between(start_us, end_us)
        present: dict[str, set[str]] = {}
        for tier in (HOT, COLD) if self.cold else (HOT,):
            present[tier] = {p.rsplit("/", 1)[1] for p in self._names(f"{self._root(tier)}/date=*")} if len(asked) > 1 else {f"date={d}" for d in asked}
        out = []
        for day in asked:
            known = manifest.days.get(day)
            tiers = [COLD, HOT] if known and known.location == COLD else [HOT, COLD]
            met: set[str] = set()
            for tier in tiers:
                folder = known.folder if known and known.location == tier else ""
                if (tier == COLD and not self.cold) or (not folder and f"date={day}" not in present[tier]):
                    continue
                base = self._root(tier, folder)
                for path in self._names(f"{base}/date={day}/shard=*"):
                    shard = path.rsplit("/", 1)[1]
                    if shard not in met and (wanted is None or shard in wanted):
                        out.append((base, path))
                        met.add(shard)
                if known and known.folder and met:
                    break  # a rewritten day is whole
        return sorted(out)

    def raw(self, partitions: list[tuple[str, str]]) -> DataFrame:
        by_base: dict[str, list[str]] = {}
        for base, path in partitions:
            by_base.setdefault(base, []).append(path)
        frames = [self.spark.read.schema(LAKE).option("basePath", base).parquet(*paths).select(*_POINTS) for base, paths in sorted(by_base.items())]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], LAKE).select(*_POINTS)

    def read(self, start_us: int, end_us: int, sensors: list[str] | None = None, dedupe: bool = True) -> DataFrame:
        """Points of [start, end], both included; of equal sensor and time the last ingested."""
        rows = self.raw(self.partitions(start_us, end_us, sensors)).where(F.col("us").between(start_us, end_us))
        if sensors is not None:
            rows = rows.where(F.col("sensor_id").isin([s.strip() for s in sensors]))
        return last_ingested(rows) if dedupe else rows

    # ---- writing ----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, base: str, mode: str) -> None:
        dealt = rows.select(*_POINTS).repartition("date", "shard").sortWithinPartitions("date", "shard", "sensor_id", "us")
        dealt.write.mode(mode).option("compression", "zstd").partitionBy("date", "shard").parquet(base)

    def _files(self, base: str, day: str) -> int:
        return len(self._names(f"{base}/date={day}/shard=*/*.parquet"))

    def append(self, points: DataFrame, now_us: int, watermark_us: int | None = None) -> Manifest:
        """Add points, each day where it lies; duplicates go to the last ingested when read, so a repeated call does no harm."""
        manifest = self.manifest()
        rows = with_partitions(points, self.shards)
        found = sorted(r["date"] for r in rows.select("date").distinct().collect())  # one a day
        by_base: dict[str, list[str]] = {}
        for day in found:
            known = manifest.days.get(day)
            tier = self.location(manifest, day, now_us) if known else HOT
            by_base.setdefault(self._root(tier, known.folder if known else ""), []).append(day)
        changed = {}
        for base, days in by_base.items():
            self._write(rows if len(by_base) == 1 else rows.where(F.col("date").isin(days)), base, "append")
            for day in days:
                known = manifest.days.get(day) or Day(HOT)
                changed[day] = replace(known, files=self._files(base, day), updated_us=now_us)
        return self.commit(manifest, changed, watermark_us)

    def _rewrite(self, manifest: Manifest, rows: DataFrame, days: list[str], location: str, now_us: int, compacted: bool) -> Manifest:
        """These days as ``rows`` has them, in a folder of their own; then the swap."""
        folder = f"g-{uuid.uuid4().hex}"
        base = self._root(location, folder)
        self._write(last_ingested(rows), base, "errorifexists")
        new = {}
        for day in days:
            old = manifest.days.get(day)
            new[day] = Day(location, folder, self._files(base, day), now_us if compacted else (old.compacted_us if old else None), now_us)
        return self.commit(manifest, new)

    def _days(self, manifest: Manifest) -> list[str]:
        """Every day of the lake, known to the manifest or not."""
        return sorted({*manifest.days, *(p.rsplit("=", 1)[1] for tier in ((HOT, COLD) if self.cold else (HOT,)) for p in self._names(f"{self._root(tier)}/date=*"))})

    def _of_days(self, manifest: Manifest, days: list[str]) -> DataFrame:
        at = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp()) * US
        return self.raw([p for d in days for p in self.partitions(at(d), at(d), manifest=manifest)])

    def compact(self, now_us: int, more_than: int = 10) -> list[str]:
        """Rewrite the days that have a partition of more than ``more_than`` files; their names."""
        manifest = self.manifest()
        busy = []
        for day in self._days(manifest):
            at = int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) * US
            if any(len(self._names(f"{path}/*.parquet")) > more_than for _, path in self.partitions(at, at, manifest=manifest)):
                busy.append(day)
        by_tier: dict[str, list[str]] = {}
        for day in busy:
            by_tier.setdefault(self.location(manifest, day, now_us), []).append(day)
        for location, days in by_tier.items():
            manifest = self._rewrite(manifest, self._of_days(manifest, days), days, location, now_us, True)
        return busy

    def backfill(self, source: DataFrame, day: str, now_us: int) -> Manifest:
        """A whole day anew from the source, in its tier: what the source no longer has is gone with the swap."""
        manifest = self.manifest()
        rows = with_partitions(source, self.shards).where(F.col("date") == day)
        return self._rewrite(manifest, rows, [day], self.location(manifest, day, now_us), now_us, False)

    def retain(self, now_us: int) -> list[str]:
        """Move the days older than the retention to the cold tier; their names."""
        if not self.cold:
            return []
        manifest, before = self.manifest(), day_of(now_us - self.retention_days * 86_400 * US)
        old = [d for d in self._days(manifest) if d < before and not ((k := manifest.days.get(d)) and k.location == COLD)]
        if old:
            self._rewrite(manifest, self._of_days(manifest, old), old, COLD, now_us, False)
        return old

    def replicate(self, source: DataFrame, now_us: int, lag_s: int = 60, late_s: int = 48 * 3600) -> Manifest:
        """Append what was ingested after the manifest's watermark, up to ``lag_s`` ago, and move the watermark.

        After an absence longer than ``late_s`` the older part of the backlog is left to a backfill, with a warning.
        """
        target = now_us - lag_s * US
        last = self.manifest().watermark_us
        since = target - late_s * US if last is None else max(last, target - late_s * US)
        at = F.col("inserted_at")
        if last is not None and last < since and not source.where((at > last) & (at <= since)).isEmpty():
            warnings.warn(f"rows ingested from {last} to {since} wait for a backfill", stacklevel=2)
        return self.append(source.where((at > since) & (at <= target)), now_us, target)

    def vacuum(self) -> list[str]:
        """Remove the rewritten folders, and the days of the roots, that no day of the manifest lies in; what went."""
        manifest, gone = self.manifest(), []
        used = {(d.location, d.folder) for d in manifest.days.values()}
        for tier in (HOT, COLD) if self.cold else (HOT,):
            for path in self._names(f"{self._root(tier)}/g-*"):
                if (tier, path.rsplit("/", 1)[1]) not in used:
                    gone.append(path)
            for path in self._names(f"{self._root(tier)}/date=*"):
                known = manifest.days.get(path.rsplit("=", 1)[1])
                if known and (known.folder or known.location != tier):
                    gone.append(path)
        for path in [*gone, *self._names(f"{self._root(HOT)}/_manifest/v=*")[:-1]]:
            self._delete(path)
        return gone
