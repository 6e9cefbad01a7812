"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    _WRITTEN.append(f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for plans that use it several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Remove the intermediate tables that this driver has written, once nothing reads them any more; how many there were."""
    gone = 0
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone
