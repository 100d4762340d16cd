"""Catalog views over star-schema tables: games from ``part``, roms from them, files from ``lineitem``.

The same views in DataFrame form and in DuckDB SQL (VIEWS_SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import vocab as V
from tallyforge.plans.work import never_broadcast

#: Each region's name once, a few pairs and short codes, and none.
REGION_TAGS = [f" ({name})" for _, name, _, _ in V.REGIONS] + [" (USA, Europe)", " (Japan, USA)", " (J)", " (U)", " (PAL)", " (DE)", "", ""]
REVISION_TAGS = ["", " (Rev 1)", " (Rev B)", "", " (Rev 2.1)", " (RE2)", " v1.2 x"]
#: Each kind of tag that a flag reads at least once, discs and tracks, and none.
FLAG_TAGS = [
    "", " (Beta)", "", " (Demo)", " [!]", "", " [b1]", " (Proto)", " (En,Fr,De)", " (Unl)", " [h1]", " (Alt 1)", "", " (Sample)", " (Aftermarket)", " (Pirate)", " [T+Eng]", " (Ger-Fre)", "", " [BIOS]", " (Disc 1)", " (Disc 2)", "",
    " (Alpha)", " [cr]", " (Debug)", " (Enhancement Chip)", " [f1]", " (Homebrew)", " [MIA]", " [o1]", " [!p]", " [p2]", " (Test Program)", " (Bung)", " [t1]", " [c]", " (Hack)", " (Kiosk)", " (Track 1)", " (Track 02 of 12)", "", "",
]


def _pick(words: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: game_ord, name, parent_key (its brand), clone_of (the brand's first game), and its attributes."""
    k = F.col("p_partkey")
    name = F.concat("p_name", _pick(REGION_TAGS, k), _pick(REVISION_TAGS, k), _pick(FLAG_TAGS, k))
    category = F.when(k % 17 == 0, "Demos").when(k % 19 == 0, "Applications").when(k % 23 == 0, "Preproduction").otherwise("Games")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("game_ord"),
        name.alias("name"),
        F.col("p_brand").alias("parent_key"),
        F.when(k % 41 == 0, "Bootleg Co").when(k % 43 == 0, "Hack Team").otherwise(F.col("p_type")).alias("manufacturer"),
        F.array(category).alias("categories"),
        (k % 97 == 0).alias("is_bios"),
        (k % 89 == 0).alias("is_device"),
        F.when(k % 4 == 0, F.array(F.lit("jpn"), F.lit("usa"))).otherwise(F.array().cast("array<string>")).alias("release_regions"),
        F.col("p_size"),
    )
    # brands are few, and each has a large share of the parts
    first = rows.groupBy("parent_key").agg(F.min_by("name", "game_ord").alias("first_name"), F.min("game_ord").alias("first_ord"))
    clone = F.when(F.col("game_ord") != F.col("first_ord"), F.col("first_name"))
    rom_of = F.when(F.col("game_ord") > 0, F.floor(F.col("game_ord") / 2)).cast("long")
    return never_broadcast(rows.join(F.broadcast(first), "parent_key").select("game_ord", "name", "parent_key", clone.alias("clone_of"), rom_of.alias("rom_of"), "manufacturer", "categories", "is_bios", "is_device", "release_regions", "p_size"))


def roms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three rows per part; which digests a rom has follows its game."""
    k, i = F.col("p_partkey"), F.col("rom_ord")
    seed = F.concat_ws("-", k, i).cast("binary")
    part = never_broadcast(spark.read.parquet(f"{sf_dir}/part.parquet"))
    rows = part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("rom_ord"))
    return rows.select(
        k.alias("game_ord"),
        "rom_ord",
        F.concat(F.lit("part-"), k, F.lit("-"), i, F.lit(".rom")).alias("name"),
        (F.col("p_size").cast("long") * 1024 + i).alias("size"),
        F.when(k % 4 != 1, F.sha1(seed)).alias("sha1"),
        F.when(k % 4 != 0, F.md5(seed)).alias("md5"),
        F.when(k % 4 == 2, F.sha2(seed, 256)).alias("sha256"),
        F.when((k % 10 == 0) & (i == 2), "nodump").otherwise("good").alias("status"),
        F.sha1(seed).alias("rom_hash"),
    )


def files(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """One row per kept line item: path, entry, container, digests, size, and whether it is in the output folder.

    The inventory lacks every seventh part and some copies of every fifth, so
    that catalogs have roms that no file matches. Rows are made distinct before
    they have digests, which part and entry tell, where the join has dealt them
    to. Without ``once`` repeated rows stay, for callers that take a minimum of
    them anyway.
    """
    part = never_broadcast(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_size"))
    lines = never_broadcast(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey % 7 <> 0 and not (l_partkey % 5 = 0 and l_linenumber % 3 = 1)"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    kind = F.when(F.col("l_returnflag") == "A", "zip").when(F.col("l_returnflag") == "R", "7z").otherwise("file")
    folder = F.when(F.col("l_linestatus") == "F", "in").otherwise("out")
    i = F.col("l_linenumber") % 3
    entry = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", cents("l_quantity"), cents("l_extendedprice"))
    below = F.concat(folder, F.lit("/"), F.col("l_suppkey"), F.lit("/"))
    rows = lines.join(part, "l_partkey").select(
        "l_partkey",
        i.alias("_i"),
        F.concat(below, entry, F.lit("."), kind).alias("path"),
        F.concat(below, F.col("l_partkey"), F.lit(".zip")).alias("archive"),
        kind.alias("container"),
        (F.col("p_size").cast("long") * 1024 + i).alias("size"),
        (F.col("l_linestatus") == "O").alias("in_output"),
        F.when(F.col("l_linenumber") == 5, 1).when(F.col("l_linenumber") > 5, 2).otherwise(0).alias("kind"),
    )
    rows = rows.distinct() if once else rows
    seed = F.concat_ws("-", "l_partkey", "_i").cast("binary")
    entry = F.concat(F.lit("part-"), F.col("l_partkey"), F.lit("-"), F.col("_i"), F.lit(".rom"))
    return rows.select("path", "archive", entry.alias("entry"), "container", "size", F.sha1(seed).alias("sha1"), F.md5(seed).alias("md5"), F.sha2(seed, 256).alias("sha256"), "in_output", "kind")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


GAMES_SQL = f"""
_g AS (SELECT p_partkey AS game_ord,
    p_name || {_list(REGION_TAGS)}[(p_partkey % {len(REGION_TAGS)} + 1)::INT] || {_list(REVISION_TAGS)}[(p_partkey % {len(REVISION_TAGS)} + 1)::INT] || {_list(FLAG_TAGS)}[(p_partkey % {len(FLAG_TAGS)} + 1)::INT] AS name,
    p_brand AS parent_key,
    CASE WHEN p_partkey % 41 = 0 THEN 'Bootleg Co' WHEN p_partkey % 43 = 0 THEN 'Hack Team' ELSE p_type END AS manufacturer,
    CASE WHEN p_partkey % 17 = 0 THEN 'Demos' WHEN p_partkey % 19 = 0 THEN 'Applications' WHEN p_partkey % 23 = 0 THEN 'Preproduction' ELSE 'Games' END AS category,
    p_partkey % 97 = 0 AS is_bios, p_partkey % 89 = 0 AS is_device, p_partkey % 4 = 0 AS released, p_size
  FROM part),
games AS (SELECT _g.*,
    CASE WHEN game_ord <> min(game_ord) OVER (PARTITION BY parent_key) THEN first_value(name) OVER (PARTITION BY parent_key ORDER BY game_ord) END AS clone_of,
    CASE WHEN game_ord > 0 THEN game_ord // 2 END AS rom_of
  FROM _g)"""
ROMS_SQL = """
roms AS (SELECT p_partkey AS game_ord, i::INT AS rom_ord, 'part-' || p_partkey || '-' || i || '.rom' AS name, p_size::BIGINT * 1024 + i AS size,
    CASE WHEN p_partkey % 4 <> 1 THEN sha1(p_partkey || '-' || i) END AS sha1,
    CASE WHEN p_partkey % 4 <> 0 THEN md5(p_partkey || '-' || i) END AS md5,
    CASE WHEN p_partkey % 4 = 2 THEN sha256(p_partkey || '-' || i) END AS sha256,
    CASE WHEN p_partkey % 10 = 0 AND i = 2 THEN 'nodump' ELSE 'good' END AS status,
    sha1(p_partkey || '-' || i) AS rom_hash
  FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE i <= p_size % 3)"""
FILES_SQL = """
_l AS (SELECT l.*, p_size, l_linenumber % 3 AS i,
    CASE l_returnflag WHEN 'A' THEN 'zip' WHEN 'R' THEN '7z' ELSE 'file' END AS container,
    CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END || '/' || l_suppkey || '/' AS folder
  FROM lineitem l JOIN part ON l_partkey = p_partkey
  WHERE l_partkey % 7 <> 0 AND NOT (l_partkey % 5 = 0 AND l_linenumber % 3 = 1)),
files AS (SELECT DISTINCT
    folder || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || round(l_quantity * 100)::BIGINT || '-' || round(l_extendedprice * 100)::BIGINT || '.' || container AS path,
    folder || l_partkey || '.zip' AS archive, 'part-' || l_partkey || '-' || i || '.rom' AS entry, container,
    p_size::BIGINT * 1024 + i AS size, sha1(l_partkey || '-' || i) AS sha1, md5(l_partkey || '-' || i) AS md5, sha256(l_partkey || '-' || i) AS sha256,
    l_linestatus = 'O' AS in_output, CASE WHEN l_linenumber = 5 THEN 1 WHEN l_linenumber > 5 THEN 2 ELSE 0 END AS kind
  FROM _l)"""


def with_views(sql: str, *views: str) -> str:
    return "WITH RECURSIVE " + ",".join(views) + ("," if sql.lstrip()[:1] != "S" else "") + sql
