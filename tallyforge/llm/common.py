"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other
    one a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tallyforge-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        return f"file://{_LOCAL[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor loses no finished work, and what
    reads the result twice computes it once.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where materialized tables are that can still be reached.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(column: str = "text") -> Column:
    return F.col(column).cast("binary")


#: Bytes of a batch that goes to Python; a larger row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has batches of rows end at BATCH_BYTES, in the session, so that what tasks hold follows from bytes and not from rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, BATCH_BYTES)


def arrow_rows(batches: Iterable[pa.RecordBatch], most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``most_bytes`` at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index("text")
        if at < 0:
            yield batch
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < n:
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b, the smallest node that each reaches."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b as (node, smallest node reached) for every other node."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = min_labels(len(nodes), codes[: len(a)], codes[len(a) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u, v = star(np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)]))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(u, v): every node of ``edges`` (long u, v) but the smallest of each component, with that smallest node.

    Each partition first shrinks its edges to a forest of stars. Then large-star
    and small-star rounds run until the edges stay the same; the edges are never
    gathered in one place. Minima are aggregated before the shuffle and written
    out, so a hot centre is a skewed equi-join that adaptive execution splits.
    """
    forest = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, "u long, v long")
    now = materialize(forest.distinct(), tag)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return now
        seen = mark
        # large-star: what is above a node moves to the least in the node's neighbourhood
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), tag)
        discard(now, least)
        # small-star: a node and what is below it move to the least below it
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        moved = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(below.select("u", "m")).distinct(), tag)
        discard(large, below)
