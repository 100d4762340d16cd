"""Filters, parents and the choice of one game per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import names as N
from tallyforge.plans.options import Options


def with_names(games: DataFrame) -> DataFrame:
    """``games`` with a column ``is_<flag>`` per flag, game_type, revision, regions and languages."""
    col = lambda c, kind: F.col(c) if c in games.columns else F.lit(None).cast(kind)
    flag = N.flags(F.col("name"), F.coalesce(col("categories", "array<string>"), F.array().cast("array<string>")), col("manufacturer", "string"), col("is_bios", "boolean"), col("is_device", "boolean"))
    keep = [c for c in games.columns if c not in {f"is_{k}" for k in flag}]
    override = lambda c: F.col(c) if c in games.columns else None
    found = N.regions(F.col("name"), override("region"), override("release_regions"))
    # retail and the type read the finished flags, whose patterns so stand in the plan once
    plain = games.select(*keep, *(v.alias(f"is_{k}") for k, v in flag.items() if k != "retail"), N.revision(F.col("name")).alias("revision"), found.alias("regions"))
    told = {k: F.col(f"is_{k}") for k in flag if k != "retail"}
    told["retail"] = N.retail(told)
    out = plain.select(*plain.columns, told["retail"].alias("is_retail"), N.game_type(told).alias("game_type"))
    return out.withColumn("languages", N.languages(F.col("name"), F.col("regions"), override("language"), override("release_languages")))


def passes(o: Options) -> Column:
    """Whether a game of ``with_names`` passes every filter; games without region or language fail filters on them."""
    ok = F.lit(True)
    if o.filter_regex:
        ok &= F.col("name").rlike(o.filter_regex)
    if o.filter_regex_exclude:
        ok &= ~F.col("name").rlike(o.filter_regex_exclude)
    if o.filter_language:
        ok &= F.coalesce(F.arrays_overlap("languages", F.array(*map(F.lit, o.filter_language))), F.lit(False))
    if o.filter_region:
        ok &= F.coalesce(F.arrays_overlap("regions", F.array(*map(F.lit, o.filter_region))), F.lit(False))
    if o.filter_category_regex:
        ok &= F.exists("categories", lambda c: c.rlike(o.filter_category_regex))
    is_ = lambda k: ~F.col("is_verified") if k == "unverified" else F.col(f"is_{k}")
    for k in sorted(o.no):
        ok &= ~is_(k)
    for k in sorted(o.only):
        ok &= is_(k)
    if o.only_retail:
        ok &= F.col("is_retail")
    return ok


def filter_games(games: DataFrame, o: Options) -> DataFrame:
    """The games that pass; of a group whose parent is gone the first left becomes the parent of the others."""
    return reelect(games.where(passes(o)))


def reelect(games: DataFrame) -> DataFrame:
    """Where no game of a parent_key is without clone_of, the first is made parent and the others name it."""
    group = Window.partitionBy("parent_key")
    kept = F.bool_or(F.col("clone_of").isNull()).over(group)
    first = F.first("name").over(group.orderBy("game_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_ord = F.min("game_ord").over(group)
    new = F.when(kept, F.col("clone_of")).when(F.col("game_ord") == first_ord, F.lit(None)).otherwise(first)
    return games.withColumn("clone_of", new)


def parent_key(id_: Column, clone_of_id: Column, clone_of: Column, name: Column) -> Column:
    """One group per game: by id where there is one, else by name."""
    return F.coalesce(clone_of_id, id_, clone_of, name)


def parent_groups(games: DataFrame) -> DataFrame:
    """parent_key, game_ord, is_parent from id, clone_of_id, name and clone_of.

    First games that are no clones found groups, by id where they have one,
    else by name; later ones of the same key join. Then clones join the group
    that they name, or found it; one without an id founds none by id and is
    left out. A game with an id that names a parent only by name is in both.
    """
    own = F.when(F.col("clone_of_id").isNull(), F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), "id")).when(F.col("clone_of").isNull(), F.concat(F.lit("name:"), "name")))
    named = F.coalesce(F.concat(F.lit("id:"), "clone_of_id"), F.concat(F.lit("name:"), "clone_of"))
    both = F.filter(F.array(F.struct(F.lit(0).alias("step"), own.alias("key")), F.struct(F.lit(1).alias("step"), named.alias("key"))), lambda x: x["key"].isNotNull())
    rows = games.select("game_ord", F.col("id").isNotNull().alias("_id"), F.explode(both).alias("g")).select("game_ord", "_id", F.col("g.key").alias("parent_key"), F.struct("g.step", "game_ord").alias("_at"))
    founds = F.when((F.col("_at.step") == 0) | F.col("_id") | F.startswith("parent_key", F.lit("name:")), F.col("_at"))
    first = rows.groupBy("parent_key").agg(F.min(founds).alias("_first"))
    return rows.join(first, "parent_key").where("_at >= _first").select("parent_key", "game_ord", (F.col("_at") == F.col("_first")).alias("is_parent"))


def has_parent_clone_info(games: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and has_parents: there are groups, and fewer than games."""
    return games.groupBy(*by).agg((F.countDistinct("parent_key") != F.count("*")).alias("has_parents"))


def infer_parents(games: DataFrame) -> DataFrame:
    """parent_key and clone_of from the names alone.

    Games that are alike without region, language and variant are a group. Its
    parent is the first game whose name without region and language is that
    bare name, else the first game. The stripped names are computed once each.
    """
    rows = games.drop("parent_key", "clone_of").withColumn("_plain", N.strip_region_language(F.col("name")))
    rows = rows.withColumn("parent_key", N.strip_variants(F.col("_plain")))
    order = F.struct((F.col("_plain") != F.col("parent_key")).cast("int"), F.col("game_ord"))
    parents = rows.groupBy("parent_key").agg(F.min_by("name", order).alias("_parent"), F.min_by("game_ord", order).alias("_ord"))
    out = rows.join(parents, "parent_key").withColumn("clone_of", F.when(F.col("game_ord") != F.col("_ord"), F.col("_parent")))
    return out.drop("_plain", "_parent", "_ord")


def _listed(values: str, wanted: tuple[str, ...]) -> Column:
    """The least place of a value in the list of preferences; past its end if there is none."""
    at = F.transform(F.col(values), lambda v: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, wanted)), v), F.lit(0)), F.lit(len(wanted) + 1)))
    return F.coalesce(F.array_min(at), F.lit(len(wanted) + 1).cast("long"))


def preference(o: Options) -> list[Column]:
    """The sort keys of a group's games, the best first; original order at last."""
    no = lambda c: (~c).cast("int")
    out: list[Column] = []
    if o.prefer_game_regex:
        out.append(no(F.col("name").rlike(o.prefer_game_regex)))
    if o.prefer_rom_regex:
        out.append(no(F.exists("rom_names", lambda r: r.rlike(o.prefer_rom_regex))))
    if o.prefer_verified:
        out.append(no(F.col("is_verified")))
    if o.prefer_good:
        out.append(F.col("is_bad").cast("int"))
    if o.prefer_language:
        out.append(_listed("languages", o.prefer_language))
    if o.prefer_region:
        out.append(_listed("regions", o.prefer_region))
    if o.prefer_revision:
        out.append(F.col("revision") * (-1 if o.prefer_revision == "newer" else 1))
    if o.prefer_retail:
        out.append(no(F.col("is_retail")))
    if o.prefer_parent:
        out.append(F.col("clone_of").isNotNull().cast("int"))
    return [*out, F.col("game_ord")]


def prefer(games: DataFrame, o: Options) -> DataFrame:
    """The best game of each parent_key, as a parent. A minimum that is aggregated before the shuffle; no group is sorted."""
    columns = [c for c in games.columns if c != "parent_key"]
    best = games.groupBy("parent_key").agg(F.min_by(F.struct(*columns), F.struct(*preference(o))).alias("g"))
    return best.select("parent_key", "g.*").withColumn("clone_of", F.lit(None).cast("string"))
