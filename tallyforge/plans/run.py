"""A whole run from options: catalogs and inputs are read, reconciled, and what the commands ask for is written."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import glob_regex
from tallyforge.operators import games as G
from tallyforge.operators import infer as I
from tallyforge.operators import matching as M
from tallyforge.operators import paths as P
from tallyforge.operators import reports as R
from tallyforge.operators import sets as S
from tallyforge.operators import sinks as W
from tallyforge.plans.options import Options
from tallyforge.plans.reconcile import Result, reconcile
from tallyforge.plans.work import stored
from tallyforge.sources import archives as A
from tallyforge.sources import catalogs as X

_OPTIONAL = {"id": "string", "clone_of_id": "string", "clone_of": "string", "rom_of": "string", "description": "string", "manufacturer": "string", "genre": "string", "is_bios": "boolean", "is_device": "boolean", "categories": "array<string>", "device_refs": "array<string>", "releases": "array<struct<name:string,region:string,language:string>>"}


def _kept(paths: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """Rows whose path matches none of the globs."""
    for g in globs:
        paths = paths.where(~F.col("path").rlike(glob_regex(g)))
    return paths


def read_games(spark: SparkSession, options: Options) -> DataFrame:
    """Games of all catalogs of ``options`` that its regexps let through, with dat_name."""
    found = None
    for path in options.dat:
        games = X.read_catalogs(spark, path)
        for c, kind in _OPTIONAL.items():
            games = games if c in games.columns else games.withColumn(c, F.lit(None).cast(kind))
        games = games.select("dat_id", "game_ord", "name", "roms", *_OPTIONAL)
        found = games if found is None else found.unionByName(games)
    if found is None:
        raise ValueError("no catalog is given")
    found = _kept(found.withColumn("path", F.col("dat_id")), options.dat_exclude).drop("path")
    xml = [p for p in options.dat if X.is_xml(spark, p)]
    if xml:
        heads = X.xml_headers(spark, xml)
        heads = heads.select("dat_id", F.coalesce("name", "dat_id").alias("name"), "description")
        wanted = X.keep_catalogs(heads, options.dat_name_regex, options.dat_name_regex_exclude, options.dat_description_regex, options.dat_description_regex_exclude)
        found = found.join(heads.select("dat_id", F.col("name").alias("dat_name")), "dat_id", "left")
        found = found.join(heads.join(wanted.select("dat_id"), "dat_id", "left_anti").select("dat_id"), "dat_id", "left_anti")
    else:
        found = found.withColumn("dat_name", F.lit(None).cast("string"))
    found = found.withColumn("dat_name", F.coalesce("dat_name", F.regexp_extract("dat_id", r"([^/]*?)(\.[^./]*)?$", 1)))
    return stored(X.one_game_per_bios(found), "catalogs")


def scan(spark: SparkSession, paths: tuple[str, ...], options: Options, bits: int, archives: bool) -> DataFrame:
    """Files and entries below ``paths``, with the digests that ``bits`` asks for."""
    files = _kept(A.scan_files(spark, list(paths)), options.input_exclude)
    rows = A.without_junk(A.scan_entries(files, options.input_checksum_quick, bits, archives))
    local = F.regexp_replace("path", "^file:/*", "/")
    return rows.where("supported").withColumn("path", local).withColumn("archive", F.col("path"))


def consoles(options: Options) -> list[tuple[str, list[str], dict[str, str]]]:
    """Regexp, extensions and tokens of each console of the JSON file that ``output_console_tokens`` names."""
    if not options.output_console_tokens:
        return []
    with open(options.output_console_tokens, encoding="utf-8") as f:
        return [(c["datRegex"], c.get("extensions", []), c["tokens"]) for c in json.load(f)["consoles"]]


def run(spark: SparkSession, options: Options) -> Result:
    """Reads, reconciles and writes. Files are read from and written to a file system that all executors mount.

    The digests that the catalogs need are worked out first, and only those are
    computed while scanning. With several catalogs, or ``dat_combine``, games
    are told apart by catalog, or are those of one.
    """
    games = read_games(spark, options)
    games = games.withColumn("parent_key", G.parent_key(F.col("id"), F.col("clone_of_id"), F.col("clone_of"), F.col("name")))
    games = games.withColumns({"release_regions": F.transform("releases", lambda r: r["region"]), "dat_id": F.lit("combined") if options.dat_combine else F.col("dat_name")})
    games = stored(games.withColumn("game_ord", F.xxhash64("dat_name", "game_ord", "name") if options.dat_combine else F.col("game_ord")), "games-read")
    roms = X.roms_of(games)
    if options.dat_combine:
        games = S.combine(games, roms)
        roms = roms.join(games.select("game_ord"), "game_ord", "left_semi")
    byname = games.select("dat_id", F.col("name").alias("_name"), F.col("game_ord").alias("_ord"))
    refs = games.select("dat_id", "game_ord", F.explode("device_refs").alias("_name")).join(byname, ["dat_id", "_name"]).select("dat_id", "game_ord", F.col("_ord").alias("device_ord"))
    linked = games.withColumn("_name", F.col("rom_of")).join(byname, ["dat_id", "_name"], "left").withColumn("rom_of", F.when(F.col("rom_of").isNotNull(), F.coalesce("_ord", F.lit(-1)))).drop("_name", "_ord", "roms", "device_refs", "releases")
    bits = M.required_checksums(roms, options.input_checksum_min, options.input_checksum_max).first()["bits"]
    archives = M.archives_need_checksums(roms, options.input_checksum_archives).first()
    files = scan(spark, options.input, options, bits, bool(archives and archives["needed"]))
    root = P.output_root(options.output) if options.output else None
    outside = scan(spark, (root,), options, bits, False) if root and os.path.isdir(root) else None
    files = files.withColumn("in_output", F.lit(False)) if outside is None else files.withColumn("in_output", F.lit(False)).unionByName(A.exclude(outside, files).withColumn("in_output", F.lit(True)))
    files = stored(files, "files")
    done = reconcile(linked, roms, files, options, device_refs=refs, consoles=consoles(options))
    write(spark, done, files, options, root)
    return done


def write(spark: SparkSession, done: Result, files: DataFrame, options: Options, root: str | None) -> None:
    """Carries out the commands of ``options`` on a result."""
    outputs = done.outputs
    if options.writes:
        existing = files.where("in_output").select("path").distinct()
        first = outputs.groupBy("out_path").agg(F.min("dat_id").alias("dat_id"), F.min("game_ord").alias("game_ord"), F.min("path").alias("path"))
        plan = R.write_plan(first, existing, options.overwrite, options.overwrite_invalid).select("out_path", "action")
        raw = "extract" not in options.commands and "zip" not in options.commands
        rows = outputs.withColumn("entry", F.lit(None).cast("string") if raw else F.col("entry")).dropDuplicates(["out_path", "out_entry"] if not raw else ["out_path"])
        mode = "copy" if not raw and "move" in options.commands else next(c for c in ("copy", "move", "link") if c in options.commands)
        mode = ("relative" if options.symlink_relative else options.link_mode) if mode == "link" else mode
        written = stored(W.write_outputs(rows.join(plan, "out_path"), mode, options.write_retry), "written")
        if failed := written.where("error is not null").limit(5).collect():
            raise OSError("; ".join(f"{r['out_path']}: {r['error']}" for r in failed))
        # what was not written stays where it is
        acted = outputs.join(plan, "out_path")
        used = acted.where("action <> 'skip'").select("path").distinct().join(acted.where("action = 'skip'").select("path"), "path", "left_anti")
        if "move" in options.commands and not raw:
            sums = files.select("path", M.content_key().alias("file_hash"))
            used = stored(R.move_delete_plan(sums.join(used, "path", "left_semi"), sums, outputs.select(F.col("out_path").alias("path"))), "moved")
            for r in used.toLocalIterator():
                os.remove(r["path"])
        if "move" in options.commands and options.move_delete_dirs != "never":
            inputs = files.where("not in_output").select("path").distinct()
            roots = [os.path.abspath(p) for p in options.input]
            for r in A.emptied_folders(inputs, used, roots, options.move_delete_dirs).orderBy(F.length("dir").desc()).toLocalIterator():
                if os.path.isdir(r["dir"]) and not os.listdir(r["dir"]):
                    os.rmdir(r["dir"])
    if "clean" in options.commands and root:
        there = A.scan_files(spark, root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
        rest = R.clean_plan(there, outputs.select(F.col("out_path").alias("path")))
        W.clean((r["path"] for r in _kept(rest, options.clean_exclude).toLocalIterator()), options.clean_backup, options.clean_dry_run, root)
    if "playlist" in options.commands:
        for r in done.playlists.toLocalIterator():
            with open(os.path.join(r["folder"] or ".", f"{r['title']}.m3u"), "w", encoding="utf-8") as f:
                f.write("\n".join(r["entries"]) + "\n")
    if "report" in options.commands and options.report_output:
        W.write_report(done.report, options.report_output)
    if "fixdat" in options.commands and options.fixdat_output:
        W.write_catalogs(_with_roms(done.games, done.fixdat), options.fixdat_output, "dat_id")
    if "dir2dat" in options.commands and options.dir2dat_output:
        W.write_catalogs(inferred(files, options), options.dir2dat_output, "dat_id")


def _with_roms(games: DataFrame, roms: DataFrame) -> DataFrame:
    fields = [c for c in ("name", "size", "crc32", "md5", "sha1", "sha256", "status") if c in roms.columns]
    lists = roms.groupBy("game_ord").agg(F.array_sort(F.collect_list(F.struct("rom_ord", *fields))).alias("roms"))
    games = games if "description" in games.columns else games.withColumn("description", F.lit(None).cast("string"))
    return games.join(lists, "game_ord")


def inferred(files: DataFrame, options: Options) -> DataFrame:
    """Games made of the inputs: one catalog per input path, named like it."""
    games = I.cascade(files, files.where("false").select("path", F.lit("").alias("content")))
    # archives give a row per entry; other files have no entry
    own = files.select("path", F.coalesce("entry", F.regexp_extract("path", "([^/]*)$", 1)).alias("rom"), "size", "crc32", "md5", "sha1", "sha256")
    rows = I.by_input(games.distinct().join(own, ["path", "rom"]), list(options.input)).withColumn("dat_id", F.regexp_extract("dat", "([^/]*)/?$", 1))
    fields = F.struct(F.col("rom").alias("name"), "size", "crc32", "md5", "sha1", "sha256")
    listed = rows.groupBy("dat_id", F.col("game").alias("name")).agg(F.array_sort(F.collect_set(fields)).alias("roms"))
    return listed.withColumns({"game_ord": F.col("name"), "clone_of": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
