"""The whole reconciliation as one plan: catalogs and inventory to statuses, outputs and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.operators import candidates as C
from tallyforge.operators import games as G
from tallyforge.operators import matching as M
from tallyforge.operators import paths as P
from tallyforge.operators import reports as R
from tallyforge.operators import sets as S
from tallyforge.operators.sinks import reported
from tallyforge.plans.options import Options
from tallyforge.plans.work import discard, never_broadcast, stored

#: Games of one catalog, at most, when games of several are numbered.
DAT_STEP = 1 << 40


@dataclass(frozen=True)
class Result:
    games: DataFrame
    roms: DataFrame
    matched: DataFrame
    statuses: DataFrame
    leftovers: DataFrame
    report: DataFrame
    outputs: DataFrame
    fixdat: DataFrame
    playlists: DataFrame


def numbered(games: DataFrame, roms: DataFrame, device_refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Games, roms and device references of several catalogs (dat_id, game_ord) with a game_ord that is the game's alone, in order of catalog and game.

    Parents are told apart by catalog too, and rom_of follows. The only windows
    are over the catalogs, and over the games of one.
    """
    dats = games.select("dat_id").distinct().withColumn("_dat", F.row_number().over(Window.orderBy("dat_id")))
    ranked = games.withColumn("_rank", F.row_number().over(Window.partitionBy("dat_id").orderBy("game_ord")))
    keyed = stored(ranked.join(F.broadcast(dats), "dat_id").withColumn("_game", F.col("_dat") * DAT_STEP + F.col("_rank")).drop("_dat", "_rank"), "numbered")
    ids = keyed.select("dat_id", "game_ord", "_game")
    renamed = lambda df, c: df.join(ids.select("dat_id", F.col("game_ord").alias(c), F.col("_game").alias("_new")), ["dat_id", c], "left" if c == "rom_of" else "inner").drop(c).withColumnRenamed("_new", c)
    roms = renamed(roms, "game_ord").drop("dat_id")
    if device_refs is not None:
        device_refs = renamed(renamed(device_refs, "game_ord"), "device_ord").select("game_ord", "device_ord")
    games = renamed(keyed, "rom_of") if "rom_of" in games.columns else keyed
    games = games.drop("game_ord").withColumnRenamed("_game", "game_ord")
    if "parent_key" in games.columns:
        games = games.withColumn("parent_key", F.concat_ws("|", "dat_id", "parent_key"))
    return games, roms, device_refs


def with_parents(games: DataFrame, options: Options) -> DataFrame:
    """Parents from the catalog where it has some, else from the names; per catalog."""
    if options.dat_ignore_parent_clone or "parent_key" not in games.columns:
        found = G.infer_parents(games)
        return found.withColumn("parent_key", F.concat_ws("|", "dat_id", "parent_key"))
    return games


def merged_sets(games: DataFrame, roms: DataFrame, options: Options, device_refs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Games and roms in the wanted merge mode; catalogs without parents stay as they are."""
    may = S.may_merge(games, options.merge_roms, ["dat_id"])
    touched = games.join(may, "dat_id", "left_semi")
    mine = roms.join(touched.select("game_ord"), "game_ord", "left_semi")
    rest = roms.join(touched.select("game_ord"), "game_ord", "left_anti")
    mode = options.merge_roms
    if mode == "fullnonmerged":
        if device_refs is not None:
            mine = S.with_device_roms(mine, device_refs.join(touched.select("game_ord"), "game_ord", "left_semi"))
        return games, mine.unionByName(rest)
    if "rom_of" in games.columns and "bios" in roms.columns:
        mine = S.without_bios_roms(touched, mine)
    if mode == "split":
        return games, S.split(touched, mine).unionByName(rest)
    if mode == "merged":
        order = Window.partitionBy("game_ord").orderBy(F.contains("name", F.lit("/")).cast("int"), "name", "rom_hash")
        one = S.merged(touched, mine).withColumn("rom_ord", F.row_number().over(order) - 1)
        kept = games.join(one.select("game_ord").union(rest.select("game_ord")).distinct(), "game_ord", "left_semi")
        return kept.withColumn("clone_of", _null()), one.unionByName(rest)
    return games, mine.unionByName(rest)


def merged_discs(games: DataFrame, roms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games of several discs as one, named like them without their disc; its first disc stands for it."""
    titled = games.withColumn("_title", N.strip_disc(F.col("name")))
    first = titled.groupBy("dat_id", "_title").agg(F.min("game_ord").alias("_first"), F.count("*").alias("n_discs"))
    rows = stored(titled.join(first, ["dat_id", "_title"]), "discs")
    renamed = S.merge_discs(rows.where("n_discs > 1").select("game_ord", "name"), roms).select("game_ord", "rom_ord", F.col("name").alias("_name"))
    roms = roms.join(renamed, ["game_ord", "rom_ord"], "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    roms = roms.join(rows.select("game_ord", "_first"), "game_ord")
    order = Window.partitionBy("_first").orderBy("game_ord", "rom_ord")
    roms = roms.withColumn("rom_ord", F.row_number().over(order) - 1).drop("game_ord").withColumnRenamed("_first", "game_ord").select(*[c for c in roms.columns if c != "_first"])
    games = rows.where("game_ord = _first").withColumn("name", F.when(F.col("n_discs") > 1, F.col("_title")).otherwise(F.col("name"))).withColumn("merged_disc", F.col("n_discs") > 1)
    return games.drop("_title", "_first", "n_discs"), roms


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _having(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with null for each of these columns that it lacks."""
    return df.withColumns({c: _null(kind) for c, kind in kinds.items() if c not in df.columns})


def inputs(games: DataFrame, roms: DataFrame, files: DataFrame, order: list[Column], raw_writing: bool) -> DataFrame:
    """game_ord, rom_ord, strength, path, archive, entry, container, in_output: the input of every rom that has one.

    The rom's first file by digest and ``order``, but from its game's archive
    if there is one that holds the whole game. Roms are matched with contents,
    each once, whose best file is found before; files themselves are dealt out
    only where they lie in archives, to tell which hold a game. Each step is
    stored until the next ones are, and what would be too long to deal out for
    every file, its digests and its name in a row for each digest, is never
    made. Repeated rows of ``files`` change nothing.
    """
    rom_id, facts, claim = ["game_ord", "rom_ord"], ["path", "archive", "entry", "container", "in_output"], []
    legal = C.legal_inputs(files.withColumns({"wanted_entry": _null(), "is_disk": F.lit(False)}), raw_writing)
    if raw_writing:
        # an entry serves only roms of its name
        claim = ["claim"]
        legal = legal.withColumn("claim", C.claimed_entry())
    fits = "claim is null or name is null or claim = name" if claim else "true"
    # the order ends with the path, which is the first of the facts
    value = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order[:-1])), *facts)
    legal = legal.withColumns({"id": M.content_id(), "value": value})
    contents = stored(M.contents(legal.select("id", *claim, "value", *(c.alias(k) for k, c in M.short_keys(legal).items())), claim), "contents")
    matches = stored(M.content_matches(roms, contents, [*rom_id, "name"] if claim else rom_id), "matches")
    first = stored(C.first_inputs(matches.join(never_broadcast(contents), "id").where(fits)).select(*rom_id, "strength", *facts), "first")
    discard(contents)
    boxed = legal.where("entry is not null").select("id", F.col("value").alias("best"), *claim)
    held = stored(never_broadcast(matches).join(boxed, "id").where(fits).select(*rom_id, "strength", "best"), "held")
    discard(matches)
    holders = held.select("*", "best.archive", "best.container")
    whole = stored(C.divisions(roms, holders, ["game_ord"], cue_may_lack=True), "whole")
    if not whole.head(1):
        # no archive is better than the first file. A join with an empty side would end before the inventory is dealt out for it, whose shuffle files would then stay
        discard(held, whole)
        return first
    # only the entries of archives that may be chosen are told apart, by a number within their archive
    entries = files.where("entry is not null").select("archive", "container", "in_output", F.xxhash64("entry", M.content_key()).alias("_entry"))
    entries = entries.join(never_broadcast(whole.select("archive").distinct()), "archive", "left_semi").distinct()
    chosen = stored(C.best_archive(games, whole, entries), "chosen")
    discard(whole)
    used = stored(C.from_archives(first, holders, never_broadcast(chosen)), "inputs")
    discard(first, held, chosen)
    return used


def reconcile(games: DataFrame, roms: DataFrame, files: DataFrame, options: Options, dat_name: str = "", device_refs: DataFrame | None = None, consoles: list[tuple[str, list[str], dict[str, str]]] | None = None) -> Result:
    """games (dat_id, game_ord, name, parent_key, clone_of ...), roms (dat_id, game_ord, rom_ord, name, size, digests, rom_hash), files (path, archive, entry, container, digests, in_output).

    Without dat_id all is one catalog, ``dat_name``. In order: parents are
    inferred where they are not given, discs put together, sets split or
    merged, games filtered, one per title preferred, and only then matched, so
    the preferred game counts even if its files are missing. Then each rom gets
    an input, from an archive that holds the whole game if there is one; games
    of excess, of clashing or of incomplete files go; and what is left gets its
    output path. Everything is a plan; no loop runs over games or files.
    """
    several_dats = "dat_id" in games.columns
    if several_dats:
        games, roms, device_refs = numbered(games, roms, device_refs)
    else:
        games = games.withColumn("dat_id", F.lit(dat_name))
    digests = dict.fromkeys(M.ALGORITHMS, "string")
    roms = _having(roms, {"status": "string", "size": "bigint", "name": "string", **digests})
    files = _having(files, {"size": "bigint", **digests})
    if options.exclude_disks and "kind" in roms.columns:
        roms = roms.where("kind <> 'disk'")
    games, roms = with_parents(games, options), S.clean_roms(roms)
    if options.merge_discs:
        games, roms = merged_discs(games, roms)
    games, roms = merged_sets(games, roms, options, device_refs)
    if options.prefer_rom_regex:
        games = games.join(roms.groupBy("game_ord").agg(F.collect_set("name").alias("rom_names")), "game_ord", "left")
    named = G.filter_games(G.with_names(games), options)
    if options.single:
        named = G.prefer(named, options)
    named = stored(named, "games")
    wanted = stored(roms.join(named.select("game_ord"), "game_ord", "left_semi"), "roms")
    # inputs
    extracting, zipping = "extract" in options.commands, "zip" in options.commands
    raw_writing = options.writes and not extracting and not zipping
    used = inputs(named, wanted, files, M.file_order(options.prefer_filetype, options.prefer_filename_regex, options.overwrite), raw_writing)
    if raw_writing:
        # whole archives are copied as they are, so a game's entries have to come from one
        facts = used.where("entry is not null").groupBy("game_ord").agg((F.countDistinct("archive") != 1).alias("_several"))
        used = used.join(facts.where("_several").select("game_ord"), "game_ord", "left_anti")
    empty = M.empty_files(wanted, used, ["game_ord", "rom_ord"]) if "link" not in options.commands else wanted.select("game_ord", "rom_ord").limit(0)
    found = used.select("game_ord", "rom_ord").union(empty)
    if not options.allow_excess_sets and raw_writing:
        in_use = used.where("entry is not null").select("game_ord", "archive", "entry")
        excess = C.excess_entries(in_use, files.where("entry is not null").select("archive", "entry"))
        used, found = C.without_excess(used, excess), C.without_excess(found, excess)
    cues = C.only_cues_missing(wanted, found.join(wanted.select("game_ord", "rom_ord", "name"), ["game_ord", "rom_ord"]))
    counts = C.completeness(wanted, found).join(cues.withColumn("_cue", F.lit(True)), "game_ord", "left")
    counts = counts.withColumn("n_found", F.when(F.col("_cue"), F.col("n_roms")).otherwise(F.col("n_found"))).drop("_cue")
    statuses = stored(R.game_status(named, counts, options.allow_incomplete_sets), "statuses")
    used = used.join(statuses.where("status <> 'MISSING'").select("game_ord"), "game_ord", "left_semi")
    # outputs
    category = F.get("categories", F.lit(0)) if "categories" in statuses.columns else _null()
    genre = F.col("genre") if "genre" in statuses.columns else _null()
    merged_disc = F.col("merged_disc") if "merged_disc" in statuses.columns else F.lit(False)
    tokens = statuses.select("game_ord", "dat_id", "name", "game_type", "regions", "languages", "n_roms", F.array(category).alias("categories"), genre.alias("genre"), merged_disc.alias("merged_disc"))
    template = options.output or "."
    tokens = C.explode_tokens(tokens, "{region}" in template, "{language}" in template, False).withColumn("category", F.get("categories", F.lit(0)))
    rows = used.join(tokens, "game_ord").join(wanted.select("game_ord", "rom_ord", F.col("name").alias("rom")), ["game_ord", "rom_ord"])
    rows = rows.withColumns({"dat_name": F.col("dat_id"), "dat_description": _null()})
    zipped, kept = F.lit(zipping), F.lit(raw_writing) & F.col("entry").isNotNull()
    base = P.output_basename(F.col("name"), F.col("rom"), F.col("path"), zipped, kept)
    file = P.in_game_dir(base, F.col("name"), F.col("rom"), options.dir_game_subdir, F.col("n_roms") > 1, zipped | kept, F.col("merged_disc"))
    rows = rows.withColumn("file", file).withColumn("folder", F.lit(template))
    if consoles:
        rows = P.console_tokens(rows.withColumn("_ext", F.regexp_extract("rom", r"(\.[^.]*)$", 1)), "folder", consoles, "dat_name", "_ext").drop("_ext")
    if consoles or "{" in template:
        rows = rows.withColumn("folder", P.replace_tokens(F.col("folder"), P.game_tokens(F.col("file"), F.col("path"))))
    if options.dir_letter:
        rows = P.letter_dirs(rows, options.dir_letter_count, options.dir_letter_limit, options.dir_letter_group, "file").withColumnRenamed("dir", "letter")
    else:
        rows = rows.withColumn("letter", _null())
    mirrored = P.mirror(F.col("path"), list(options.input)) if options.dir_mirror else _null()
    by_dat = F.col("dat_name") if options.dir_dat_name else _null()
    inner = F.when(zipped, F.col("rom"))
    outputs = rows.select("dat_id", "game_ord", "rom_ord", "name", "path", "entry", "container", P.join_path(F.col("folder"), mirrored, by_dat, F.col("letter"), F.col("file")).alias("out_path"), inner.alias("out_entry")).where(~P.has_leftover(F.col("out_path")))
    steps = []
    if options.writes:
        # read several times, to find what clashes
        steps.append(outputs := stored(outputs, "candidates"))
        if not raw_writing:
            steps.append(clash := stored(C.conflicts(outputs.where("out_entry is null")).select("game_ord").distinct(), "clash"))
            outputs = outputs.join(never_broadcast(clash), "game_ord", "left_anti")
        outputs = C.validated(outputs)
    if zipping and options.zip_dat_name:
        one = C.combined(outputs.drop("entry").withColumnRenamed("out_entry", "entry"))
        folder = P.join_path(P.replace_tokens(F.lit(template), {}), F.concat("dat_id", F.lit(".zip")))
        outputs = one.select("dat_id", "game_ord", "name", "path", folder.alias("out_path"), F.col("entry").alias("out_entry"))
    outputs = stored(outputs, "outputs")
    discard(*steps)
    # reports
    leftovers = R.file_status(files.select("path", M.content_key().alias("file_hash")), used)
    report = R.report_rows(reported(statuses), used.select("game_ord", "path"), leftovers, F.col("dat_id") if several_dats else dat_name)
    written = wanted.join(found, ["game_ord", "rom_ord"], "left_semi")
    lists = R.playlists(named, outputs, options.playlist_extensions, options.playlist_mode)
    return Result(named, wanted, used, statuses, leftovers, report, outputs, R.fixdat(wanted, written), lists)
