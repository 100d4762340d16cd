"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local session, else one in the warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tallyforge-work-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df``, which the next join deals out by its keys instead of sending all of it through the driver.

    The planner's estimate follows from the bytes of compressed files: it knows
    of no explosion, and takes every digest or name for 20 bytes, so that a
    table of millions of rows passes for a small one.
    """
    return df.hint("merge")


#: Whether Spark deletes the shuffle files of a write when it is done, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: iterations and lost executors go on from there.

    Its shuffle files go with the write, so that the disk a plan takes is that
    of its largest step and of the tables, not of all its steps. Zstandard, as
    digests in hex take half the bytes then; Snappy leaves them as they are.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where stored tables are that can still be reached.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more: all that was made of them is stored itself."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
