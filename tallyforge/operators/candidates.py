"""From matches to candidates: whole archives, excess, completeness, conflicts, copies per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.work import stored


def archives_with_every_rom(roms: DataFrame, entries: DataFrame) -> DataFrame:
    """(game_ord, archive): archives that hold all roms of a game.

    Relational division by counting: distinct contents of a game found in an
    archive against distinct contents of the game. ``entries``: archive,
    rom_hash, one row per entry.
    """
    wanted = roms.select("game_ord", "rom_hash").distinct()
    sizes = wanted.groupBy("game_ord").agg(F.count("*").alias("n_wanted"))
    found = wanted.join(entries.select("archive", "rom_hash").distinct(), "rom_hash").groupBy("game_ord", "archive").agg(F.count("*").alias("n_found"))
    return found.join(sizes, "game_ord").where("n_found = n_wanted").select("game_ord", "archive")


def best_archive(games: DataFrame, divided: DataFrame, entries: DataFrame) -> DataFrame:
    """(game_ord, archive): one archive per game: not in the output, of few entries, CHD first, named like the game."""
    facts = entries.groupBy("archive").agg(F.bool_or("in_output").alias("_out"), F.count("*").alias("_n"), F.bool_or(F.col("container") == "chd").alias("_chd"))
    rows = divided.join(facts, "archive").join(games.select("game_ord", "name"), "game_ord")
    order = F.struct(F.col("_out").cast("int"), "_n", (~F.col("_chd")).cast("int"), (~F.contains("archive", F.col("name"))).cast("int"), "archive")
    return rows.groupBy("game_ord").agg(F.min_by("archive", order).alias("archive"))


def choose_inputs(matched: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of all matches (game_ord, rom_ord, path, archive, match_rank) one per rom: from the game's archive if it has one, else the first."""
    rows = matched.join(chosen.withColumnRenamed("archive", "_archive"), "game_ord", "left")
    order = F.struct((~F.coalesce(F.col("archive") == F.col("_archive"), F.lit(False))).cast("int"), "match_rank")
    rest = [c for c in matched.columns if c not in ("game_ord", "rom_ord")]
    return rows.groupBy("game_ord", "rom_ord").agg(F.min_by(F.struct(*rest), order).alias("m")).select("game_ord", "rom_ord", "m.*")


def first_inputs(matched: DataFrame, best: str = "best") -> DataFrame:
    """game_ord, rom_ord, strength and the fields of ``best``: of all matches of a rom that of the strongest digest, then of the least ``best``.

    A minimum that is aggregated before the shuffle.
    """
    fields = [f.name for f in matched.schema[best].dataType.fields]
    least = matched.groupBy("game_ord", "rom_ord").agg(F.min(F.struct(F.negate("strength").alias("_weak"), best)).alias("m"))
    return least.select("game_ord", "rom_ord", F.negate("m._weak").alias("strength"), *(F.col(f"m.{best}.{f}") for f in fields))


def from_archives(first: DataFrame, held: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``first``, one per rom; where its game has an archive in ``chosen`` (game_ord, archive) that holds the rom, the first input of there."""
    mine = first_inputs(held.join(chosen, ["game_ord", "archive"]).drop("archive"))
    rest = [c for c in first.columns if c not in ("game_ord", "rom_ord")]
    mine = mine.select("game_ord", "rom_ord", F.struct(*rest).alias("_mine"))
    rows = first.select("game_ord", "rom_ord", F.struct(*rest).alias("_first")).join(mine, ["game_ord", "rom_ord"], "left")
    return rows.select("game_ord", "rom_ord", F.coalesce("_mine", "_first").alias("m")).select("game_ord", "rom_ord", "m.*")


def excess_entries(used: DataFrame, entries: DataFrame) -> DataFrame:
    """(game_ord, archive, entry): entries of an archive that a game uses, but not for it. ``used``: game_ord, archive, entry."""
    touched = used.select("game_ord", "archive").distinct()
    return touched.join(entries.select("archive", "entry").distinct(), "archive").join(used.select("game_ord", "archive", "entry"), ["game_ord", "archive", "entry"], "left_anti").select("game_ord", "archive", "entry")


def without_excess(candidates: DataFrame, excess: DataFrame) -> DataFrame:
    """Candidates of games that have no excess entry."""
    return candidates.join(excess.select("game_ord").distinct(), "game_ord", "left_anti")


def completeness(roms: DataFrame, matched: DataFrame) -> DataFrame:
    """game_ord, n_roms, n_found: how many of each game's roms have a file."""
    hits = matched.select("game_ord", "rom_ord").distinct().withColumn("_hit", F.lit(1))
    rows = roms.select("game_ord", "rom_ord").join(hits, ["game_ord", "rom_ord"], "left")
    return rows.groupBy("game_ord").agg(F.count("*").alias("n_roms"), F.count("_hit").alias("n_found"))


def conflicts(outputs: DataFrame) -> DataFrame:
    """(game_ord, out_path): a game writes one path from several inputs. ``outputs``: game_ord, out_path, path."""
    return outputs.groupBy("game_ord", "out_path").agg(F.countDistinct("path").alias("n_inputs")).where("n_inputs > 1")


def shared_outputs(outputs: DataFrame) -> DataFrame:
    """(dat_id, out_path): several games of a catalog write one path from several inputs."""
    counts = outputs.groupBy("dat_id", "out_path").agg(F.countDistinct("game_ord").alias("n_games"), F.countDistinct("path").alias("n_inputs"))
    return counts.where("n_games > 1 and n_inputs > 1")


def validated(outputs: DataFrame) -> DataFrame:
    """Candidates of catalogs without shared outputs; one such path discards all of its catalog."""
    return outputs.join(shared_outputs(outputs).select("dat_id").distinct(), "dat_id", "left_anti")


def explode_tokens(games: DataFrame, region: bool = True, language: bool = True, category: bool = True) -> DataFrame:
    """A copy of each game per region, language and category that its output path names; null where it has none."""
    for wanted, many, one in ((region, "regions", "region"), (language, "languages", "language"), (category, "categories", "category")):
        games = games.withColumn(one, F.explode_outer(F.array_distinct(many)) if wanted else F.lit(None).cast("string"))
    return games


def combined(outputs: DataFrame) -> DataFrame:
    """One candidate for a whole catalog: the first rom of each name, under its game's folder if the game has several."""
    first = outputs.groupBy("dat_id", "entry").agg(F.min_by(F.struct("game_ord", "name", "path"), F.struct("game_ord", "rom_ord")).alias("r"))
    rows = first.select("dat_id", "entry", "r.*").withColumn("_n", F.count("*").over(Window.partitionBy("dat_id", "game_ord")))
    return rows.withColumn("entry", F.when(F.col("_n") > 1, F.concat("name", F.lit("/"), "entry")).otherwise(F.col("entry"))).drop("_n")


def _wants(suffix: str) -> Column:
    """Whether the rom has a digest of the bytes named by ``suffix``."""
    out = F.lit(False)
    for algo in ("crc32", "md5", "sha1", "sha256"):
        out |= F.coalesce(F.col(f"rom_{algo}") == F.col(f"{algo}{suffix}"), F.lit(False))
    return out


def reconcile(pairs: DataFrame, writing: bool, testing: bool = False, linking: bool = False, add_padding: bool = False, remove_headers: list[str] | None = None) -> DataFrame:
    """Adds keeps_header, keeps_padding and missing to rows of rom and chosen input.

    Rows have rom_<digest>, <digest> of the raw and <digest>_wo of the
    headerless bytes, header (null: none), paddings (array of structs with
    digests) and extension. In order: without input the rom is missing; when
    nothing is written or tested the input stands; headers and paddings are
    forgotten when not writing, and when the raw bytes are wanted; a headered
    input cannot be linked where other bytes are wanted; a wanted padding
    stays only if padding may be added.
    """
    padded = F.exists(
        "paddings",
        lambda p: F.coalesce(F.col("rom_crc32") == p["crc32"], F.lit(False)) | F.coalesce(F.col("rom_md5") == p["md5"], F.lit(False)) | F.coalesce(F.col("rom_sha1") == p["sha1"], F.lit(False)) | F.coalesce(F.col("rom_sha256") == p["sha256"], F.lit(False)),
    )
    has_header, has_padding = F.col("header").isNotNull(), F.coalesce(F.size("paddings") > 0, F.lit(False))
    if not writing:
        header, padding = (F.lit(False), F.lit(False)) if testing else (has_header, has_padding)
        return pairs.withColumns({"keeps_header": header, "keeps_padding": padding, "missing": F.col("path").isNull()})
    removes = F.col("extension").isin(remove_headers) if remove_headers else F.lit(remove_headers is not None)
    header = has_header & ~(_wants("") & ~removes)
    bad_link = F.lit(linking) & has_header & ~_wants("")
    padding = has_padding & ~_wants("") & padded & F.lit(add_padding)
    return pairs.withColumns({"keeps_header": header, "keeps_padding": padding, "missing": F.col("path").isNull() | bad_link})


#: Why a whole archive cannot be used as it is, in the order in which reasons are tried.
RAW_REASONS = ["dir2dat", "zip_dat", "not_entry", "header_differs", "padding_wanted", "extracted", "zip_from_other", "entry_path_differs", "several_archives", "zip_unstructured", "zip_not_torrentzip", "zip_not_rvzstd"]


def raw_reason(facts: dict[str, Column], merged_disc: Column | None = None) -> Column:
    """The first of RAW_REASONS whose fact holds, or null. A merged-disc game that writes several files passes the last four."""
    out = F.lit(None).cast("string")
    for i, reason in reversed(list(enumerate(RAW_REASONS))):
        fact = F.coalesce(facts.get(reason, F.lit(False)), F.lit(False))
        if i >= 8 and merged_disc is not None:
            fact &= ~merged_disc
        out = F.when(fact, reason).otherwise(out)
    return out


#: Containers whose entries can be read out, and those in which the path of an entry means something.
EXTRACTABLE, MEANINGFUL = ("zip", "tar", "gzip"), ("zip", "tar", "rar", "7z")


def claimed_entry(meaningful: tuple[str, ...] = MEANINGFUL) -> Column:
    """The path that an entry has to be wanted by, where archives are written as they are; null: any."""
    return F.when(F.col("entry").isNotNull() & F.col("container").isin(*meaningful), F.col("entry"))


def legal_inputs(matched: DataFrame, raw_writing: Column | bool, extractable: tuple[str, ...] = EXTRACTABLE, meaningful: tuple[str, ...] = MEANINGFUL) -> DataFrame:
    """Matches (container, entry, wanted_entry, is_disk) whose input can serve its rom.

    Unless archives are written as they are, an entry must be one that can be
    read out, but for disks. Where they are, an entry's path must be the wanted
    one in containers whose paths mean something; a nameless rom (null
    wanted_entry) takes any.
    """
    raw = F.lit(raw_writing) if isinstance(raw_writing, bool) else raw_writing
    inside = F.col("entry").isNotNull()
    unreadable = ~raw & inside & ~F.coalesce("is_disk", F.lit(False)) & ~F.col("container").isin(*extractable)
    misplaced = raw & F.coalesce(F.col("wanted_entry") != claimed_entry(meaningful), F.lit(False))
    return matched.where(~(unreadable | misplaced))


def writable(candidates: DataFrame) -> DataFrame:
    """Candidates (game_ord, can_be_input) all of whose inputs may be read from."""
    return candidates.withColumn("_can", F.bool_and("can_be_input").over(Window.partitionBy("game_ord"))).where("_can").drop("_can")


def divisions(roms: DataFrame, held: DataFrame, by: list[str], cue_may_lack: bool = False) -> DataFrame:
    """``by`` and archive: archives that hold every rom of a game, or of a game's disc where ``by`` names one.

    ``held``: ``by``, rom_ord, archive, container for every rom that an archive
    has. All roms count, also equal ones, so this is equality of the lists of
    contents. With ``cue_may_lack``, cue sheets may be missing from disc
    images, in which there are none.
    """
    cue = F.lower("name").endswith(".cue")
    sizes = roms.groupBy(*by).agg(F.count("*").alias("_all"), F.count_if(~cue).alias("_tracks"))
    holds = held.groupBy(*by, "rom_ord", "archive").agg(F.bool_or(F.col("container") == "chd").alias("_image"))
    found = roms.select(*by, "rom_ord", "name").join(holds, [*by, "rom_ord"]).groupBy(*by, "archive").agg(F.count("*").alias("_n"), F.count_if(~cue).alias("_n_tracks"), F.bool_or("_image").alias("_image"))
    whole = F.col("_n") == F.col("_all")
    if cue_may_lack:
        whole |= F.col("_image") & (F.col("_n_tracks") == F.col("_tracks")) & (F.col("_tracks") > 0)
    return found.join(sizes, by).where(whole).select(*by, "archive")


def _field(name: str):
    return lambda x: x[name]


def raw_facts(rows: DataFrame, dir2dat: bool = False, zip_dat: bool = False, extracting: bool = False, zipping: bool = False, zip_format: str = "torrentzip") -> DataFrame:
    """game_ord, reason: why a game's archive cannot be used as it is, the first of RAW_REASONS that holds; null: it can.

    ``rows``, one per rom and chosen input: game_ord, rom_<digest>, header,
    <digest>_wo, paddings, container, archive, entry, wanted_entry, out_path,
    zip_kind (torrentzip, rvzstd or null) and merged_disc. Reasons of one rom
    hold for its game; the reasons from ``several_archives`` on are about the
    whole game, and do not count for merged discs that write several files.
    """
    anyone = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    digests = ("crc32", "md5", "sha1", "sha256")
    other = F.lit(False)
    padded = F.lit(False)
    for d in digests:
        other |= F.coalesce(F.col(f"{d}_wo").isNotNull() & ~F.col(f"{d}_wo").eqNullSafe(F.col(f"rom_{d}")), F.lit(False))
        padded |= F.coalesce(F.array_contains(F.transform("paddings", _field(d)), F.col(f"rom_{d}")), F.lit(False))
    zipped = F.lit(zipping)
    is_zip = F.col("container") == "zip"
    per = rows.groupBy("game_ord").agg(
        anyone(F.col("entry").isNull()).alias("not_entry"),
        anyone(F.col("header").isNotNull() & other).alias("header_differs"),
        anyone(padded).alias("padding_wanted"),
        anyone(zipped & ~is_zip).alias("zip_from_other"),
        anyone(F.col("container").isin("zip", "tar", "rar", "7z") & (F.col("wanted_entry") != F.col("entry"))).alias("entry_path_differs"),
        (F.countDistinct("archive") != 1).alias("several_archives"),
        (anyone(F.col("merged_disc")) & (F.count("*") > 1) & (F.countDistinct("out_path") > 1)).alias("_free"),
        (zipped & F.bool_and(is_zip) & anyone(F.col("zip_kind").isNull())).alias("zip_unstructured"),
        (zipped & F.bool_and(is_zip) & F.lit(zip_format == "torrentzip") & anyone(F.col("zip_kind") != "torrentzip")).alias("zip_not_torrentzip"),
        (zipped & F.bool_and(is_zip) & F.lit(zip_format == "rvzstd") & anyone(F.col("zip_kind") != "rvzstd")).alias("zip_not_rvzstd"),
    )
    facts = {x: F.col(x) for x in per.columns if x in RAW_REASONS} | {"dir2dat": F.lit(dir2dat), "zip_dat": F.lit(zip_dat), "extracted": F.lit(extracting)}
    return per.select("game_ord", raw_reason(facts, F.col("_free")).alias("reason"))


def as_archives(rows: DataFrame, reasons: DataFrame, writing: bool, extracting: bool, zipping: bool) -> DataFrame:
    """``rows`` (game_ord, entry, is_disk ...) with whole: the input is its archive, to be copied as it is.

    Games without a reason, and disks always, use the whole archive. With a
    reason, entries that are written but neither extracted nor zipped are
    dropped; other inputs are used one by one.
    """
    inside, disk = F.col("entry").isNotNull(), F.coalesce("is_disk", F.lit(False))
    whole = inside & (F.col("reason").isNull() | disk)
    lost = inside & ~whole & F.lit(writing and not extracting and not zipping)
    return rows.join(reasons, "game_ord", "left").withColumn("whole", whole).where(~lost).drop("reason")


def only_cues_missing(roms: DataFrame, found: DataFrame) -> DataFrame:
    """game_ord of cue and bin games of which nothing but cue sheets is missing: disc images hold no sheet."""
    name = F.lower("name")
    cue, track = name.endswith(".cue"), name.endswith(".bin")
    have = found.select("game_ord", "name").distinct().withColumn("_found", F.lit(True))
    rows = roms.join(have, ["game_ord", "name"], "left")
    ok = rows.groupBy("game_ord").agg((F.bool_or(cue) & F.bool_or(track) & F.bool_and(cue | track) & F.bool_and(F.col("_found").isNotNull() | cue)).alias("_ok"))
    return ok.where("_ok").select("game_ord")


def output_digests(rows: DataFrame, writing: bool, zipping: bool) -> DataFrame:
    """``rows`` with out_size, out_<digest> and out_kind (entry of a zip, or file).

    Raw bytes, else those without the header that is to go, else those of the
    one padding that is left. Zipped roms, and zip entries when nothing is
    written, are entries unless the input is a whole archive.
    """
    stripped, padded = F.col("header").isNotNull(), F.size(F.coalesce("paddings", F.array().cast(rows.schema["paddings"].dataType))) == 1
    choose = lambda raw, p: F.when(padded, F.get("paddings", F.lit(0))[p]).when(stripped, F.col(f"{raw}_wo")).otherwise(F.col(raw))
    entry = (F.lit(zipping) & ~F.col("whole")) | (F.lit(not writing) & (F.col("container") == "zip") & F.col("entry").isNotNull())
    return rows.withColumns({"out_size": choose("size", "padded_size"), **{f"out_{d}": choose(d, d) for d in ("crc32", "md5", "sha1", "sha256")}, "out_kind": F.when(entry, "entry").otherwise("file")})


def with_archive_hashes(candidates: DataFrame, files: DataFrame, needed: bool) -> DataFrame:
    """Candidates with the digests of their whole archives, from ``files`` (path, crc32, size) read only if outputs are tested afterwards."""
    if not needed:
        return candidates.withColumns({"archive_size": F.lit(None).cast("long"), "archive_crc32": F.lit(None).cast("string")})
    sums = files.select(F.col("path").alias("archive"), F.col("size").alias("archive_size"), F.col("crc32").alias("archive_crc32")).distinct()
    return candidates.join(sums, "archive", "left")


def output_dirs(outputs: DataFrame) -> DataFrame:
    """dir: the folders that outputs are written to, for cleaning."""
    return outputs.select(F.regexp_replace("out_path", "/[^/]*$", "").alias("dir")).distinct()


def write_order(candidates: DataFrame) -> list[Column]:
    """What candidates (n_roms, name) are written by: those of few roms first, then by name."""
    return [F.col("n_roms"), F.col("name")]


def placed(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """``candidates`` with place from 1 in ``order``: dealt out by ranges of it, numbered in each, and moved on by what is in the ranges before."""
    ranged = stored(candidates.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).drop("_size")
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(before, "_range").withColumn("place", (F.col("_n") + F.col("_before")).cast("long")).drop("_range", "_n", "_before")


def candidates_of(games: DataFrame, candidates: DataFrame) -> DataFrame:
    """``games`` (game_ord, name, game_hash) with candidate: by hash, else the first that is alike in name and description."""
    by_hash = candidates.groupBy("game_hash").agg(F.min("candidate").alias("_strong"))
    by_name = candidates.groupBy("name", "description").agg(F.min("candidate").alias("_weak"))
    rows = games.join(by_hash, "game_hash", "left").join(by_name, ["name", "description"], "left")
    return rows.withColumn("candidate", F.coalesce("_strong", "_weak")).drop("_strong", "_weak")
