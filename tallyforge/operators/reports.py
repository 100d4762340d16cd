"""Statuses, reports, and plans of what to write, move and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.functions.text import basename, dirname, extension
from tallyforge.plans.work import never_broadcast

# The report's columns in order.
REPORT_COLUMNS = ["DAT Name", "Game Name", "Status", "ROM Files", "Patched", "BIOS", "Retail Release", "Unlicensed", "Debug", "Demo", "Beta", "Sample", "Prototype", "Program", "Aftermarket", "Homebrew", "Bad"]
REPORT_FLAGS = ["bios", "retail", "unlicensed", "debug", "demo", "beta", "sample", "prototype", "program", "aftermarket", "homebrew", "bad"]


def game_status(games: DataFrame, counts: DataFrame, allow_incomplete: bool = True) -> DataFrame:
    """``games`` with n_roms, n_found and status: FOUND with all roms (or none expected), INCOMPLETE with some if allowed, else MISSING."""
    rows = games.join(counts, "game_ord", "left").na.fill(0, ["n_roms", "n_found"])
    some = F.lit(allow_incomplete) & (F.col("n_found") > 0)
    return rows.withColumn("status", F.when(F.col("n_found") >= F.col("n_roms"), "FOUND").when(some, "INCOMPLETE").otherwise("MISSING"))


def file_status(files: DataFrame, used: DataFrame) -> DataFrame:
    """path, status of files that no game uses: DUPLICATE if their content is used by another file, else UNUSED.

    ``files``: path, file_hash; ``used``: path. Contents are made distinct
    before they are joined.
    """
    used = used.select("path").distinct()
    unused = files.join(used, "path", "left_anti")
    contents = files.join(used, "path", "left_semi").select("file_hash").distinct().withColumn("_used", F.lit(True))
    return unused.join(contents, "file_hash", "left").select("path", F.when(F.col("_used"), "DUPLICATE").otherwise("UNUSED").alias("status")).distinct()


def status_summary(statuses: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """kind, n_all, n_found, n_incomplete for games, BIOSes, devices and retail games: conditional counts in one pass."""
    kinds = {"games": F.lit(True), "bioses": F.col("is_bios"), "devices": F.col("is_device"), "retail": F.col("is_retail")}
    kinds = {k: v for k, v in kinds.items() if flags is None or k in flags}
    counts = [F.struct(F.lit(k).alias("kind"), F.count_if(v).alias("n_all"), F.count_if(v & (F.col("status") == "FOUND")).alias("n_found"), F.count_if(v & (F.col("status") == "INCOMPLETE")).alias("n_incomplete")) for k, v in kinds.items()]
    return statuses.agg(F.array(*counts).alias("k")).select(F.explode("k").alias("k")).select("k.*")


def allowed_kinds(only: frozenset[str], no: frozenset[str], only_retail: bool) -> list[str]:
    """Which kinds a report counts: those asked for, else games and all that are not ruled out."""
    wanted = [k for k, on in (("bioses", "bios" in only), ("devices", "device" in only), ("retail", only_retail)) if on]
    return wanted or ["games", *(k for k, f in (("bioses", "bios"), ("devices", "device")) if f not in no), "retail"]


def summary_text(summary: DataFrame) -> DataFrame:
    """One row: ``found/all kind`` for each kind that has any, joined by commas."""
    told = F.when(F.col("n_all") > 0, F.concat(F.format_number("n_found", 0), F.lit("/"), F.format_number("n_all", 0), F.lit(" "), "kind"))
    return summary.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", told.alias("told")))), lambda x: x["told"]), ", ").alias("summary"))


def percent_band(found: Column, all_: Column) -> Column:
    """100, 75, 50, 25 or 0: the band that a share is in."""
    share = F.when(all_ == 0, 100.0).otherwise(100.0 * found / all_)
    return F.when(share >= 100, 100).when(share >= 75, 75).when(share >= 50, 50).when(share > 0, 25).otherwise(0)


def report_rows(statuses: DataFrame, used: DataFrame, leftovers: DataFrame, dat_name: str | Column, deleted: DataFrame | None = None) -> DataFrame:
    """The report's rows as strings, with section and sort_key to order by: games, then duplicate, unused and deleted files.

    ``statuses`` has the name flags; ``used``: game_ord, path.
    """
    listed = used.groupBy("game_ord").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("_paths"))
    rows = statuses.join(listed, "game_ord", "left")
    patched = F.col("is_patched") if "is_patched" in statuses.columns else F.lit(False)
    values = [F.lit(dat_name) if isinstance(dat_name, str) else dat_name, F.col("name"), F.col("status"), F.coalesce("_paths", F.lit("")), patched.cast("string"), *(F.col(f"is_{k}").cast("string") for k in REPORT_FLAGS)]
    games = rows.select(F.lit(0).alias("section"), F.col("name").alias("sort_key"), *(v.alias(c) for v, c in zip(values, REPORT_COLUMNS, strict=True)))
    if deleted is not None:
        leftovers = leftovers.unionByName(deleted.select("path", F.lit("DELETED").alias("status")))
    blank = [F.lit(""), F.lit(""), F.col("status"), F.col("path"), *([F.lit("false")] * (len(REPORT_COLUMNS) - 4))]
    section = F.when(F.col("status") == "DUPLICATE", 1).when(F.col("status") == "UNUSED", 2).otherwise(3)
    return games.unionByName(leftovers.select(section.alias("section"), F.col("path").alias("sort_key"), *(v.alias(c) for v, c in zip(blank, REPORT_COLUMNS, strict=True))))


def fixdat(roms: DataFrame, written: DataFrame) -> DataFrame:
    """All roms of games of which a rom's content was not written. ``written``: rom_hash."""
    missing = roms.join(written.select("rom_hash").distinct(), "rom_hash", "left_anti").select("game_ord").distinct()
    return roms.join(missing, "game_ord", "left_semi")


def playlists(games: DataFrame, outputs: DataFrame, extensions: tuple[str, ...], mode: str = "multiple") -> DataFrame:
    """title, folder, entries: the playable files of each title in order. multiple: only titles with two or more."""
    rows = outputs.join(games.select("game_ord", N.strip_disc(F.col("name")).alias("title")), "game_ord").where(F.lower(extension(F.col("out_path"))).isin(list(extensions)))
    lists = rows.groupBy("title").agg(F.array_sort(F.collect_set("out_path")).alias("paths"))
    lists = lists.where(F.size("paths") >= (2 if mode == "multiple" else 1)).withColumn("folder", common_dir(F.col("paths")))
    below = F.when(F.col("folder") == "", F.col("paths")).otherwise(F.transform("paths", lambda p: F.substring(p, F.length("folder") + 2, F.length(p))))
    return lists.select("title", "folder", below.alias("entries"))


def common_dir(paths: Column) -> Column:
    """The longest folder that all paths lie in; empty if there is none."""
    parts = lambda p: F.split(dirname(p), "/")
    shared = F.aggregate(paths, parts(F.element_at(paths, 1)), lambda acc, p: F.transform(F.filter(F.sequence(F.lit(1), F.size(acc)), lambda i: F.slice(acc, 1, i) == F.slice(parts(p), 1, i)), lambda i: F.element_at(acc, i)))
    return F.array_join(F.filter(shared, lambda x: x != "."), "/")


def write_plan(outputs: DataFrame, existing: DataFrame, overwrite: bool = False, overwrite_invalid: bool = False) -> DataFrame:
    """``outputs`` with action: write, or for a path that is there skip, overwrite, or test (overwrite if it is invalid).

    Of several outputs to one path the first is written, by catalog and game.
    """
    first = Window.partitionBy("out_path").orderBy("dat_id", "game_ord", "path")
    rows = outputs.withColumn("_n", F.row_number().over(first)).join(never_broadcast(existing.select(F.col("path").alias("out_path")).distinct().withColumn("_there", F.lit(True))), "out_path", "left")
    there = "overwrite" if overwrite else "test" if overwrite_invalid else "skip"
    return rows.withColumn("action", F.when(F.col("_n") > 1, "skip").when(F.col("_there"), there).otherwise("write")).drop("_n", "_there")


def clean_plan(output_files: DataFrame, written: DataFrame, excluded: DataFrame | None = None, exclude_regex: str | None = None) -> DataFrame:
    """Paths in the output folder that were not written and are not excluded."""
    rest = output_files.select("path").distinct().join(written.select("path").distinct(), "path", "left_anti")
    if excluded is not None:
        rest = rest.join(excluded.select("path").distinct(), "path", "left_anti")
    return rest.where(~F.col("path").rlike(exclude_regex)) if exclude_regex else rest


def move_delete_plan(moved: DataFrame, files: DataFrame, written: DataFrame) -> DataFrame:
    """Paths to delete after a move: all inputs of a moved content, but archives with an entry that was not moved, and what was written.

    ``files``: path, file_hash (a row per entry of an archive), container.
    """
    contents = moved.select("file_hash").distinct().withColumn("_moved", F.lit(True))
    rows = files.join(contents, "file_hash", "left")
    whole = rows.groupBy("path").agg(F.bool_and(F.col("_moved").isNotNull()).alias("_all")).where("_all")
    return whole.select("path").join(written.select("path").distinct(), "path", "left_anti")


def missing_dependencies(games: DataFrame, device_refs: DataFrame, found: DataFrame) -> DataFrame:
    """(game_ord, needed): parents and devices of found games that are themselves not found."""
    have = never_broadcast(found.select("game_ord").distinct())
    parents = games.where("clone_of is not null").select("game_ord", "parent_key").join(games.where("clone_of is null").select("parent_key", F.col("game_ord").alias("needed")), "parent_key")
    needs = parents.select("game_ord", "needed").union(device_refs.select("game_ord", F.col("device_ord").alias("needed"))).join(have, "game_ord", "left_semi")
    return needs.join(have.withColumnRenamed("game_ord", "needed"), "needed", "left_anti").select("game_ord", "needed").distinct()


def patch_join(matched: DataFrame, patches: DataFrame) -> DataFrame:
    """One row per input and patch for its CRC32: the patched file's name, digest and size; other digests are unknown."""
    rows = matched.join(patches, matched["crc32"] == patches["crc_before"])
    return rows.select("game_ord", "rom_ord", "path", "patch_id", F.col("rom_name").alias("name"), F.col("crc_after").alias("out_crc32"), F.col("size_after").alias("out_size"))


def with_extension(name: Column, ext: Column, mode: str = "auto") -> Column:
    """A file name with the extension that its content has; upper case stays upper. auto: only names without one."""
    old = extension(name)
    upper = (old != "") & (F.upper(old) == old) & (F.lower(old) != old)
    new = F.concat(F.regexp_replace(name, r"\.[a-zA-Z0-9]+$", ""), F.when(upper, F.upper(ext)).otherwise(ext))
    wanted = ext.isNotNull() & (F.lit(mode == "always") | (F.lit(mode == "auto") & ((old == "") | (F.coalesce(name, F.lit("")) == ""))))
    return F.when(wanted, new).otherwise(name)


def size_totals(roms: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_roms, n_bytes."""
    return roms.groupBy(*by).agg(F.count("*").alias("n_roms"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def files_by_path(files: DataFrame) -> DataFrame:
    """path, n_entries, n_bytes: how many entries a file has."""
    return files.groupBy("path").agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def moved_inputs(moved: DataFrame, files: DataFrame, rewritten: bool) -> DataFrame:
    """path: all files with a content that was moved; if outputs were extracted or zipped only those of the container that was read.

    ``moved`` and ``files``: path, file_hash, container.
    """
    contents = moved.select("file_hash", *(["container"] if rewritten else [])).distinct()
    return files.join(contents, contents.columns, "left_semi").select("path").distinct()
