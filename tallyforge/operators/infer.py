"""Catalogs inferred from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import basename, dirname, name_without_extensions


def from_archives(files: DataFrame) -> DataFrame:
    """game, rom, path, entry: every archive is a game, named like it without the container's extension."""
    rows = files.where("entry is not null and container <> 'file'")
    name = F.trim(basename(F.regexp_replace("path", r"(?i)\.(tar\.gz|[a-z0-9]+)$", "")))
    return rows.select(name.alias("game"), F.col("entry").alias("rom"), "path", "entry")


def from_sheets(sheets: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """game, rom, path: a cue or gdi sheet (path, content) and the files beside it that it names.

    A cue names them in FILE lines, a gdi as the fifth word of each track line.
    Sheets that name a file that is not there are left out.
    """
    if kind == "cue":
        named = F.regexp_extract_all("content", F.lit(r'(?im)^\s*FILE\s+"?(.+?)"?\s+[A-Z0-9]+\s*$'), F.lit(1))
    else:
        lines = F.filter(F.split("content", r"\r?\n"), lambda x: x.rlike(r'^\s*[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+\s+\S'))
        named = F.transform(lines, lambda x: F.regexp_replace(F.regexp_extract(x, r'^\s*[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+\s+("[^"]+"|\S+)', 1), '"', ""))
    rows = sheets.where(F.col("path").rlike(rf"(?i)\.{kind}$")).select("path", F.explode(F.array_distinct(F.concat(F.array(basename(F.col("path"))), named))).alias("rom"))
    rows = rows.withColumn("track", F.concat(dirname(F.col("path")), F.lit("/"), "rom")).withColumnRenamed("path", "sheet")
    found = rows.join(files.select(F.col("path").alias("track")).distinct().withColumn("_there", F.lit(True)), "track", "left")
    whole = found.withColumn("_all", F.bool_and(F.col("_there").isNotNull()).over(Window.partitionBy("sheet"))).where("_all")
    return whole.select(name_without_extensions(F.col("sheet")).alias("game"), "rom", F.col("track").alias("path"))


def from_raw(files: DataFrame, root_depth: int = 1) -> DataFrame:
    """game, rom, path: files of a nested folder with several are one game, named like it; others stand alone.

    ``root_depth``: how many parts of a path belong to the input itself.
    """
    rows = files.select("path", dirname(F.col("path")).alias("_dir"))
    alike = F.count("*").over(Window.partitionBy("_dir"))
    nested = F.size(F.split("_dir", "/")) > root_depth
    game = F.when(nested & (alike > 1), basename(F.col("_dir"))).otherwise(name_without_extensions(F.col("path")))
    return rows.select(game.alias("game"), basename(F.col("path")).alias("rom"), "path")


def cascade(files: DataFrame, sheets: DataFrame, root_depth: int = 1) -> DataFrame:
    """game, rom, path of all files: archives first, then cue sheets, gdi sheets, and what is left; each takes its files away."""
    archives = from_archives(files).select("game", "rom", "path")
    rest = files.join(archives.select("path").distinct(), "path", "left_anti")
    out = archives
    for kind in ("cue", "gdi"):
        discs = from_sheets(sheets.join(rest.select("path"), "path", "left_semi"), rest, kind)
        out, rest = out.union(discs), rest.join(discs.select("path").distinct(), "path", "left_anti")
    return out.union(from_raw(rest, root_depth))


def by_input(files: DataFrame, inputs: list[str]) -> DataFrame:
    """A row per file and input path that it lies under."""
    prefixes = F.array(*(F.lit(p.rstrip("/") + "/") for p in inputs))
    under = F.filter(prefixes, lambda p: F.startswith(F.col("path"), p))
    return files.select("*", F.explode(under).alias("dat")).withColumn("dat", F.regexp_replace("dat", "/$", ""))


def enrich(files: DataFrame) -> DataFrame:
    """Files of one content share their digests: by CRC32 and size, then MD5, SHA-1, SHA-256, each gives the others of the last file that has them.

    Each step aggregates by key before it joins back, so a content that many
    files have is not gathered in one task.
    """
    digests = ["crc32", "md5", "sha1", "sha256"]
    for key in digests:
        by = [key, "size"] if key == "crc32" else [key]
        others = [d for d in digests if d != key]
        last = files.where(F.col(key).isNotNull()).groupBy(*by).agg(*(F.max(F.when(F.col(d).isNotNull(), F.struct("file_ord", d)))[d].alias(f"_{d}") for d in others))
        files = files.join(last, by, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in others else F.col(c) for c in files.columns))
    return files
