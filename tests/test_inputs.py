"""Inputs found by contents, against all matches of all files; and the disk that steps leave behind."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import candidates as C
from tallyforge.operators import matching as M
from tallyforge.operators.paths import letter_dirs
from tallyforge.plans import reconcile
from tallyforge.plans.options import Options
from tallyforge.plans.reconcile import inputs
from tallyforge.plans.work import stored, work_dir

ROM = "game_ord long, rom_ord int, name string, size long, crc32 string, md5 string, sha1 string, sha256 string"
FILE = "path string, archive string, entry string, container string, in_output boolean, size long, crc32 string, md5 string, sha1 string, sha256 string"


def _tables(spark):
    digest = lambda i: (i, f"c{i}", f"m{i}", f"s{i}", f"h{i}")
    roms = []
    for g in range(12):
        for r in range(g % 4 + 1):
            size, crc32, md5, sha1, sha256 = digest(5 * (g % 3) + r)
            roms.append((g, r, f"{r}.rom", size, crc32, md5 if g % 2 else None, sha1 if g % 3 else None, sha256 if g % 5 == 0 else None))
    files = []
    for n in range(300):
        size, crc32, md5, sha1, sha256 = digest(n % 15)
        container = ["file", "zip", "7z", "tar"][n // 15 % 4]
        box = f"in/{n // 60}.{container}"
        if n % 17 == 0 or (n % 15 in (3, 4, 8) if container == "file" else n % 15 == 12):
            continue
        # files of one content differ in the digests they have
        path, entry = (f"in/{n}.rom", None) if container == "file" else (f"{box}/{n}", f"{n % 15 % 5 if n % 4 else n}.rom")
        files.append((path, path if container == "file" else box, entry, container, n % 3 == 0, size, crc32, md5 if n % 2 else None, sha1 if n % 7 else None, sha256 if n % 3 else None))
    return spark.createDataFrame(roms, ROM), spark.createDataFrame(files, FILE)


@pytest.mark.parametrize("raw", [False, True])
def test_inputs_are_those_of_all_matches(spark, raw):
    roms, files = _tables(spark)
    games = roms.select("game_ord").distinct().withColumn("name", F.lit("5"))
    order = M.file_order("plain" if raw else None, None, True)
    matched = M.match(roms, M.file_keys(files, ["path", "archive", "entry", "container", "in_output"]), ["game_ord", "rom_ord"], order)
    matched = C.legal_inputs(matched.join(roms.select("game_ord", "rom_ord", F.col("name").alias("wanted_entry")), ["game_ord", "rom_ord"]).withColumn("is_disk", F.lit(False)), raw)
    entries = files.where("entry is not null").select("archive", "entry", "container", "in_output", M.content_key().alias("rom_hash")).distinct()
    chosen = C.best_archive(games, C.divisions(roms, matched.where("entry is not null"), ["game_ord"], cue_may_lack=True), entries)
    assert chosen.count() > 1
    facts = ["game_ord", "rom_ord", "path", "archive", "entry", "container", "in_output"]
    want = sorted(C.choose_inputs(matched, chosen).select(*facts).collect(), key=str)
    got = sorted(inputs(games, roms, files, order, raw).select(*facts).collect(), key=str)
    assert got == want and any(r["entry"] for r in got) and any(not r["entry"] for r in got)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.getName() for x in map(disk.getAllFiles().apply, range(disk.getAllFiles().size()))}
    known, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rows = spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).count()
    assert stored(rows, "grouped").count() == 5000
    for _ in range(20):
        left = {x for x in held() - known if x.endswith(".data")}
        # the count itself makes shuffles, of a row each; only that of the step is longer
        if not any(f.length() > 2000 for f in [disk.getFile(x) for x in left]):
            break
        time.sleep(0.25)
    else:
        raise AssertionError(left)
    assert spark.conf.get(key, None) == before


def test_inputs_leave_only_their_own_table(spark):
    roms, files = _tables(spark)
    games = roms.select("game_ord").distinct().withColumn("name", F.lit("5"))
    there = lambda: set(glob.glob(f"{work_dir(spark).removeprefix('file://')}/*"))
    known = there()
    found = inputs(games, roms, files, M.file_order(), False)
    assert len(there() - known) == 1 and found.count()


def test_repeated_files_change_no_input(spark):
    roms, files = _tables(spark)
    games = roms.select("game_ord").distinct().withColumn("name", F.lit("5"))
    rows = lambda f: sorted(map(str, inputs(games, roms, f, M.file_order(), False).collect()))
    assert rows(files.union(files)) == rows(files)


def test_contents_keep_no_long_digest(spark):
    _, files = _tables(spark)
    found = M.contents(files.select(M.content_id().alias("id"), F.col("path").alias("value"), *(c.alias(k) for k, c in M.short_keys(files).items())), [])
    assert {"_sha256", "_crc32"} < set(found.columns) and not set(M.ALGORITHMS) & set(found.columns)
    assert {len(r[k]) for r in found.collect() for k in found.columns if k.startswith("_") and r[k] is not None} == {16}


def test_where_no_archive_holds_a_game_files_are_not_dealt_out_for_one(spark, monkeypatch):
    """A join with an empty side ended before the inventory was dealt out, and left its shuffle files."""
    roms, files = _tables(spark)
    roms = roms.union(spark.createDataFrame([(g, 9, "9.rom", 1, None, "none", None, None) for g in range(12)], ROM))
    games = roms.select("game_ord").distinct().withColumn("name", F.lit("5"))
    tags, order = [], M.file_order()
    monkeypatch.setattr(reconcile, "stored", lambda df, tag: tags.append(tag) or stored(df, tag))
    facts = ["game_ord", "rom_ord", "path", "archive", "entry", "container", "in_output"]
    got = sorted(inputs(games, roms, files, order, False).select(*facts).collect(), key=str)
    assert tags[-1] == "whole"
    matched = M.match(roms, M.file_keys(files, ["path", "archive", "entry", "container", "in_output"]), ["game_ord", "rom_ord"], order)
    matched = C.legal_inputs(matched.withColumns({"wanted_entry": F.lit(None).cast("string"), "is_disk": F.lit(False)}), False)
    want = C.choose_inputs(matched, games.select("game_ord", F.lit("").alias("archive")).limit(0))
    assert got and got == sorted(want.select(*facts).collect(), key=str)


def test_outputs_are_made_once_and_then_searched_for_clashes(spark, monkeypatch):
    """Before, every search joined all inputs with their games and letters anew, and all at once took the disk of that several times."""
    roms, files = _tables(spark)
    games = roms.select("game_ord").distinct().withColumns({"name": F.concat(F.lit("g"), "game_ord"), "parent_key": F.lit("p"), "clone_of": F.when(F.col("game_ord") > 0, "g0")})
    # the third and fourth rom of a game get one path
    name = F.when(F.col("rom_ord") == 2, "g:.rom").when(F.col("rom_ord") == 3, "g;.rom").otherwise(F.concat(F.lit("g"), "game_ord", F.lit("-"), "rom_ord"))
    roms = roms.withColumns({"rom_hash": F.concat_ws("-", "game_ord", "rom_ord"), "name": name})
    plans, folders = {}, lambda: set(glob.glob(f"{work_dir(spark).removeprefix('file://')}/*"))
    monkeypatch.setattr(reconcile, "stored", lambda df, tag: plans.setdefault(tag, df) and stored(df, tag))
    known = folders()
    options = Options(commands=frozenset({"copy", "extract"}), allow_incomplete_sets=True, output="o", dir_letter=True)
    found = reconcile.reconcile(games, roms, files, options).outputs
    file = lambda g, r: ["g%d-0", "g%d-1", "g;.rom"][r].replace("%d", str(g))
    want = sorted((g, r, f"o/G/g{g}/{file(g, r)}" if g % 4 else f"o/G/{file(g, r)}") for g in range(12) if g % 4 < 3 for r in range(g % 4 + 1))
    assert sorted(found.select("game_ord", "rom_ord", "out_path").collect()) == want
    sources = {f.rsplit("/", 2)[1].split("-")[0] for f in plans["outputs"].inputFiles()}
    assert sources == {"candidates", "clash"}
    assert not {"candidates", "clash"} & {f.rsplit("/", 1)[1].split("-")[0] for f in folders() - known}


@pytest.mark.parametrize("limit", [None, 2])
def test_letters_are_joined_only_with_a_limit(spark, limit):
    names = ["a/1.rom", "a/2.rom", "b.rom", "7.rom", "ab.rom", "ac.rom"]
    rows = spark.createDataFrame([("d", n, n.upper()) for n in names], "dat_id string, file string, name string")
    found = letter_dirs(rows, limit=limit, name="file")
    assert {r["file"]: (r["dir"], r["name"]) for r in found.collect()} == {n: (d if limit else d[0], n.upper()) for n, d in zip(names, ["A1", "A1", "B", "#", "A1", "A2"])}
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == bool(limit)
