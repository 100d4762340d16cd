"""Merging and splitting sets, discs, and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.operators.matching import keep_first
from tallyforge.plans.work import never_broadcast, stored


def clean_roms(roms: DataFrame) -> DataFrame:
    """Roms that were dumped, the first of each name in a game."""
    return keep_first(roms.where("coalesce(status, '') <> 'nodump'"), ["game_ord", "name"], "rom_ord")


def with_device_roms(roms: DataFrame, device_refs: DataFrame) -> DataFrame:
    """Full non-merged sets: the roms of each distinct device that a game names (game_ord, device_ord) come before its own."""
    refs = device_refs.select("game_ord", "device_ord").distinct()
    theirs = roms.withColumnRenamed("game_ord", "device_ord").join(refs, "device_ord").withColumn("from_device", F.lit(True))
    own = roms.withColumn("from_device", F.lit(False)).withColumn("device_ord", F.lit(None).cast("long"))
    both = own.unionByName(theirs)
    order = Window.partitionBy("game_ord").orderBy(F.col("from_device").desc(), F.col("device_ord").desc_nulls_last(), "rom_ord")
    return both.withColumn("rom_ord", F.row_number().over(order) - 1).drop("from_device", "device_ord")


def roots(games: DataFrame) -> DataFrame:
    """(game_ord, root): the end of each chain of rom_of. A chain that leaves the catalog or runs in a circle has root null.

    Pointer jumping: each round doubles the distance, so the longest chain takes
    log2 of its links in joins; what is open after log2 of the number of games
    is a circle. Each round's table is stored.
    """
    known = games.select(F.col("game_ord").alias("at")).withColumn("_there", F.lit(True))
    now = games.select("game_ord", F.coalesce("rom_of", "game_ord").alias("at"), F.col("rom_of").isNull().alias("ended"))
    now = stored(now.join(known, "at", "left_semi").select("game_ord", "at", "ended"), "roots")
    for _ in range(max(1, games.count().bit_length())):
        if not now.where("not ended").head(1):
            break
        step = now.select(F.col("game_ord").alias("at"), F.col("at").alias("_far"), F.col("ended").alias("_far_ended"))
        onward = now.join(step, "at").select("game_ord", F.when(F.col("ended"), F.col("at")).otherwise(F.col("_far")).alias("at"), (F.col("ended") | F.col("_far_ended")).alias("ended"))
        now = stored(onward, "roots")
    return games.select("game_ord").join(now.where("ended").select("game_ord", F.col("at").alias("root")), "game_ord", "left")


def split(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Split sets: a clone keeps only the roms that its parent has not under the same name with the same content."""
    parents = games.where("clone_of is null").select("parent_key", F.col("game_ord").alias("parent_ord"))
    clones = games.where("clone_of is not null").select("game_ord", "parent_key").join(parents, "parent_key")
    name = F.coalesce("merge", "name") if "merge" in roms.columns else F.col("name")
    have = roms.select(F.col("game_ord").alias("parent_ord"), F.col("name").alias("_name"), F.col("rom_hash").alias("_hash"))
    mine = never_broadcast(roms.join(never_broadcast(clones.select("game_ord", "parent_ord")), "game_ord", "left").withColumn("_wanted", name))
    on = ["parent_ord"]
    return mine.join(have.withColumnsRenamed({}), [mine["parent_ord"] == have["parent_ord"], mine["_wanted"] == have["_name"], mine["rom_hash"] == have["_hash"]], "left_anti").drop("_wanted", *on)


def merged(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Merged sets: one game per parent_key with the roms of all; a clone's are named ``clone/rom`` and come first, equal contents once.

    A group without a parent has its first game for one.
    """
    first = games.groupBy("parent_key").agg(F.min_by("game_ord", F.struct(F.col("clone_of").isNotNull().cast("int"), "game_ord")).alias("parent_ord"))
    members = games.join(first, "parent_key").select("game_ord", "parent_ord", F.col("name").alias("_game"))
    rows = roms.join(members, "game_ord")
    clone = F.col("game_ord") != F.col("parent_ord")
    rows = rows.withColumn("name", F.when(clone, F.concat("_game", F.lit("/"), "name")).otherwise(F.col("name")))
    rows = rows.withColumn("_order", F.struct((~clone).cast("int"), "game_ord", "rom_ord"))
    rest = [c for c in roms.columns if c not in ("game_ord", "rom_hash")]
    best = rows.groupBy("parent_ord", "rom_hash").agg(F.min_by(F.struct(*rest), F.col("_order")).alias("r"))
    return best.select(F.col("parent_ord").alias("game_ord"), "rom_hash", "r.*").select(*roms.columns)


def may_merge(games: DataFrame, mode: str | None, by: list[str]) -> DataFrame:
    """``by`` of the catalogs that are merged or split at all: a mode is given, and some game has a parent."""
    told = games.groupBy(*by).agg(F.count("*").alias("_n"), F.countDistinct("parent_key").alias("_parents"))
    return told.where(F.lit(mode is not None) & (F.col("_n") != F.col("_parents"))).select(*by)


def without_bios_roms(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Roms that a game's BIOS does not have: of the game at the end of its chain of rom_of all, or if that is no BIOS those marked ``bios``.

    Games whose chain leaves the catalog or runs in a circle keep all.
    """
    ends = roots(games).where("root is not null and root <> game_ord")
    theirs = roms.join(games.select("game_ord", "is_bios"), "game_ord").where("is_bios or bios is not null")
    have = theirs.select(F.col("game_ord").alias("root"), F.col("name").alias("_name"), F.col("rom_hash").alias("_hash"))
    name = F.coalesce("merge", "name") if "merge" in roms.columns else F.col("name")
    mine = roms.join(ends, "game_ord", "left").withColumn("_wanted", name)
    return mine.join(have, [mine["root"] == have["root"], mine["_wanted"] == have["_name"], mine["rom_hash"] == have["_hash"]], "left_anti").select(*roms.columns)


def merged_disks(games: DataFrame, disks: DataFrame) -> DataFrame:
    """Disks of merged sets: those of all games of a parent_key under its parent, the first of each name."""
    first = games.groupBy("parent_key").agg(F.min_by("game_ord", F.struct(F.col("clone_of").isNotNull().cast("int"), "game_ord")).alias("parent_ord"))
    rows = disks.join(games.join(first, "parent_key").select("game_ord", "parent_ord"), "game_ord")
    order = F.struct((F.col("game_ord") == F.col("parent_ord")).cast("int"), "game_ord", "rom_ord")
    return rows.groupBy("parent_ord", "name").agg(F.min_by("rom_hash", order).alias("rom_hash")).select(F.col("parent_ord").alias("game_ord"), "name", "rom_hash")


def disc_groups(games: DataFrame) -> DataFrame:
    """title, game_ords in order, n_discs: games that differ only in their disc or track."""
    return games.groupBy(N.strip_disc(F.col("name")).alias("title")).agg(F.array_sort(F.collect_list("game_ord")).alias("game_ords"), F.count("*").alias("n_discs"))


def merge_discs(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Roms of all discs of a title in one game; where two contents share a name, every rom is named ``game/rom``."""
    titled = games.select("game_ord", F.col("name").alias("_game"), N.strip_disc(F.col("name")).alias("title"))
    rows = roms.join(titled, "game_ord")
    clash = rows.groupBy("title", "name").agg(F.countDistinct("rom_hash").alias("n")).where("n > 1").groupBy("title").agg(F.lit(True).alias("clashes"))
    rows = rows.join(clash, "title", "left")
    return rows.withColumn("name", F.when(F.col("clashes"), F.concat("_game", F.lit("/"), "name")).otherwise(F.col("name"))).select("title", "game_ord", "rom_ord", "name", "size", "rom_hash")


def game_hash(games: DataFrame, roms: DataFrame, by: tuple[str, ...] = ("game_ord",)) -> DataFrame:
    """(``by``, game_hash): the name and the contents in order of their hash."""
    lists = roms.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("rom_hash")), "|").alias("_roms"))
    return games.join(never_broadcast(lists), [*by], "left").select(*by, F.concat_ws("|", "name", F.coalesce("_roms", F.lit(""))).alias("game_hash"))


def combine(games: DataFrame, roms: DataFrame, by: tuple[str, ...] = ("game_ord",)) -> DataFrame:
    """One catalog of several: of games with one name and the same contents the first stays.

    ``by`` tells games and their roms apart, and gives the order; where catalogs
    number their games each for itself, it begins with the catalog.
    """
    first = game_hash(games, roms, by).groupBy("game_hash").agg(F.min(F.struct(*by)).alias("_first"))
    return games.join(never_broadcast(first.select("_first.*")), [*by], "left_semi")
