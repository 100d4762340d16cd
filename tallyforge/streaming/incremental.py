"""Scanning again only what is new: a snapshot keyed by path, size and time, for batches and for file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.archives import scan_entries

KEY = ["path", "size", "mtime"]


def unseen(files: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """Files (path, size, mtime ...) that the snapshot has not in this state."""
    return files if snapshot is None else files.join(snapshot.select(*KEY).distinct(), KEY, "left_anti")


def still_valid(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the snapshot whose files are still there and the same."""
    return snapshot.join(files.select(*KEY).distinct(), KEY, "left_semi")


def rescan(files: DataFrame, snapshot: DataFrame | None, quick: bool = False) -> DataFrame:
    """Entries of all files: those of unchanged ones from the snapshot, the rest read. The result is the next snapshot."""
    fresh = unseen(files, snapshot)
    entries = scan_entries(fresh, quick).withColumnRenamed("size", "entry_size").join(fresh.select(*KEY), "path")
    return entries if snapshot is None else still_valid(snapshot, files).unionByName(entries)


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, quick: bool = False, once: bool = True) -> StreamingQuery:
    """A file stream that appends the entries of new files below ``folder`` to the Parquet ``table``; each file is read once."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        scan_entries(batch.select("path", "content"), quick).write.mode("append").parquet(table)

    writer = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
