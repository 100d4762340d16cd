"""Readers of catalogs: three kinds of XML, one of nested text, one of tab-separated lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import names as N
from tallyforge.functions.text import hex_key, well_formed

_ATTR = T.StringType()


def _attributes(*names: str) -> list[T.StructField]:
    return [T.StructField(f"_{n}", _ATTR) for n in names]


_ROM = T.StructType(_attributes("name", "size", "crc", "md5", "sha1", "sha256", "status", "merge", "bios"))
_RELEASE = T.StructType(_attributes("name", "region", "language"))
#: What is read of a game; all else is never parsed.
GAME = T.StructType(
    [
        *_attributes("name", "id", "cloneof", "cloneofid", "romof", "isbios", "isdevice"),
        *(T.StructField(n, T.StringType()) for n in ("description", "manufacturer", "genre")),
        T.StructField("category", T.ArrayType(T.StringType())),
        T.StructField("release", T.ArrayType(_RELEASE)),
        T.StructField("device_ref", T.ArrayType(T.StructType(_attributes("name")))),
        T.StructField("rom", T.ArrayType(_ROM)),
        T.StructField("disk", T.ArrayType(_ROM)),
    ]
)
HEADER = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description", "version", "date", "author", "url", "comment")])
_PART = T.StructType([*_attributes("name"), T.StructField("dataarea", T.ArrayType(T.StructType([T.StructField("rom", T.ArrayType(_ROM))]))), T.StructField("diskarea", T.ArrayType(T.StructType([T.StructField("disk", T.ArrayType(_ROM))])))])
SOFTWARE = T.StructType([*_attributes("name", "cloneof"), T.StructField("description", T.StringType()), T.StructField("part", T.ArrayType(_PART))])

WIDTHS = {"crc32": 8, "md5": 32, "sha1": 40, "sha256": 64}
ROM_TYPE = "array<struct<kind:string,name:string,size:bigint,crc32:string,md5:string,sha1:string,sha256:string,status:string,merge:string,bios:string>>"


def _digest(c: Column, width: int) -> Column:
    return well_formed(hex_key(F.nullif(F.trim(c), F.lit("")), width), width)


def _size(c: Column) -> Column:
    """Decimal or 0x digits; what is no number is 0."""
    return F.coalesce(F.when(F.lower(c).startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(F.regexp_extract(c, r"^\s*([0-9]+)", 1)).try_cast("bigint"), F.lit(0)).cast("bigint")


def _rom(kind: str):
    return lambda r: F.struct(
        F.lit(kind).alias("kind"), F.regexp_replace(r["_name"], r"\\", "/").alias("name"), _size(r["_size"]).alias("size"), *(_digest(r[f"_{'crc' if a == 'crc32' else a}"], w).alias(a) for a, w in WIDTHS.items()), r["_status"].alias("status"), r["_merge"].alias("merge"), r["_bios"].alias("bios")
    )


def _listed(kind: str, column: str) -> Column:
    return F.coalesce(F.transform(column, _rom(kind)), F.array().cast(ROM_TYPE)).cast(ROM_TYPE)


def xml_games(spark: SparkSession, paths: list[str] | str, row_tag: str = "game") -> DataFrame:
    """dat_id (the file), game_ord and the attributes and roms of every ``game`` or ``machine`` of XML catalogs."""
    rows = spark.read.option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "_value").schema(GAME).xml(paths)
    yes = lambda c: F.coalesce(F.lower(F.col(c)) == "yes", F.lit(False))
    return rows.select(
        F.col("_metadata.file_path").alias("dat_id"),
        F.monotonically_increasing_id().alias("game_ord"),
        F.col("_name").alias("name"),
        F.col("_id").alias("id"),
        F.col("_cloneof").alias("clone_of"),
        F.col("_cloneofid").alias("clone_of_id"),
        F.col("_romof").alias("rom_of"),
        yes("_isbios").alias("is_bios"),
        yes("_isdevice").alias("is_device"),
        "description",
        "manufacturer",
        "genre",
        F.coalesce("category", F.array().cast("array<string>")).alias("categories"),
        F.coalesce(F.transform("release", lambda r: F.struct(r["_name"].alias("name"), F.upper(r["_region"]).alias("region"), r["_language"].alias("language"))), F.array().cast("array<struct<name:string,region:string,language:string>>")).alias("releases"),
        F.coalesce(F.transform("device_ref", lambda r: r["_name"]), F.array().cast("array<string>")).alias("device_refs"),
        F.concat(_listed("rom", "rom"), _listed("disk", "disk")).alias("roms"),
    )


def xml_headers(spark: SparkSession, paths: list[str] | str, row_tag: str = "header") -> DataFrame:
    return spark.read.option("rowTag", row_tag).schema(HEADER).xml(paths).select(F.col("_metadata.file_path").alias("dat_id"), *HEADER.names)


def software_games(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Games of software lists: the roms of all data areas of all parts, and the disks."""
    rows = spark.read.option("rowTag", "software").schema(SOFTWARE).xml(paths)
    every = lambda area, of: F.flatten(F.transform(F.flatten(F.transform("part", lambda p: F.coalesce(p[area], F.array().cast(SOFTWARE["part"].dataType.elementType[area].dataType)))), lambda a: F.coalesce(a[of], F.array().cast(T.ArrayType(_ROM)))))
    rows = rows.withColumn("_roms", every("dataarea", "rom")).withColumn("_disks", every("diskarea", "disk"))
    return rows.select(F.col("_metadata.file_path").alias("dat_id"), F.monotonically_increasing_id().alias("game_ord"), F.col("_name").alias("name"), F.col("_cloneof").alias("clone_of"), "description", F.concat(_listed("rom", "_roms"), _listed("disk", "_disks")).alias("roms"))


def roms_of(games: DataFrame) -> DataFrame:
    """One row per rom, with rom_ord and rom_hash."""
    rows = games.select("dat_id", "game_ord", F.posexplode("roms").alias("rom_ord", "r")).select("dat_id", "game_ord", "rom_ord", "r.*")
    return rows.withColumn("rom_hash", F.coalesce("sha256", "sha1", "md5", F.concat_ws("|", "crc32", "size")))


_TOKEN = re.compile(r'\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))', re.S)


def parse_nested(text: str) -> list[tuple[str, dict]]:
    """Top-level blocks of ``key ( key value key ( ... ) )`` text; a key that comes again has a list."""
    tokens = [("(" if m[1] else ")" if m[2] else "v", re.sub(r'\\(["\\])', r"\1", m[3]) if m[3] is not None else m[4]) for m in _TOKEN.finditer(text) if m[0].strip()]
    at = 0

    def block() -> dict:
        nonlocal at
        out: dict = {}
        while at < len(tokens) and tokens[at][0] != ")":
            if tokens[at][0] == "(":
                at += 1
                continue
            key, at = tokens[at][1], at + 1
            if at < len(tokens) and tokens[at][0] == "(":
                at += 1
                value = block()
                at += 1
            elif at < len(tokens) and tokens[at][0] == "v":
                value, at = tokens[at][1], at + 1
            else:
                value = ""
            out.setdefault(key, []).append(value)
        return out

    found = []
    while at < len(tokens):
        kind, key = tokens[at]
        at += 1
        if kind == "v" and at < len(tokens) and tokens[at][0] == "(":
            at += 1
            found.append((key, block()))
            at += 1
    return found


NESTED = "dat_id string, dat_name string, game_ord long, name string, clone_of string, rom_of string, description string, manufacturer string, roms array<struct<name:string,size:string,crc:string,md5:string,sha1:string,sha256:string,status:string,merge:string>>"
_SNIFF = re.compile(r"^\s*(?:clrmamepro|game|resource|machine)\s*\(", re.I | re.M)


def nested_games(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Games of catalogs in nested text, in the columns of ``xml_games`` that it has. Files in another format give no row."""
    fields = ("name", "size", "crc", "md5", "sha1", "sha256", "status", "merge")
    kinds = pa.list_(pa.struct([(f, pa.string()) for f in fields]))
    names = [f.split()[0] for f in NESTED.split(", ")[:8]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = lambda d, k: d[k][0] if k in d and isinstance(d[k][0], str) else None
        for batch in batches:
            rows: list[list] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not _SNIFF.search(text or ""):
                    continue
                blocks = parse_nested(text)
                dat = next((first(b, "name") for k, b in blocks if k.lower() == "clrmamepro"), None)
                for i, (key, b) in enumerate(blocks):
                    if key.lower() in ("game", "resource", "machine"):
                        roms = [{f: first(r, f) for f in fields} for r in b.get("rom", []) if isinstance(r, dict)]
                        rows.append([path, dat, i, first(b, "name"), first(b, "cloneof"), first(b, "romof"), first(b, "description"), first(b, "manufacturer"), roms])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if n == "game_ord" else pa.string()) for n, c in zip(names, columns, strict=False)), pa.array(columns[8], kinds)], names=[*names, "roms"])

    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = texts.mapInArrow(run, NESTED)
    rom = lambda r: F.struct(
        F.lit("rom").alias("kind"), r["name"].alias("name"), _size(r["size"]).alias("size"), *(_digest(r["crc" if a == "crc32" else a], w).alias(a) for a, w in WIDTHS.items()), r["status"].alias("status"), r["merge"].alias("merge"), F.lit(None).cast("string").alias("bios")
    )
    return rows.withColumn("roms", F.transform("roms", rom).cast(ROM_TYPE))


def tsv_games(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Games of tab-separated catalogs: sha256, name, sha1, md5, crc, size. Rows need a name and a well-formed digest; tracks of one disc are one game."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("sha256 string, path string, sha1 string, md5 string, crc32 string, size string").csv(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("dat_id"), F.monotonically_increasing_id().alias("row_ord"), F.regexp_replace("path", r"\\", "/").alias("path"), _size(F.col("size")).alias("size"), *(well_formed(F.lower(F.trim(F.col(a))), w).alias(a) for a, w in WIDTHS.items()))
    rows = rows.where((F.coalesce("path", F.lit("")) != "") & F.coalesce("crc32", "md5", "sha1", "sha256").isNotNull())
    game = N.strip_track(F.regexp_replace("path", r"\.[^./]*$", ""))
    entry = F.struct("row_ord", F.struct(F.lit("rom").alias("kind"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "size", *WIDTHS, *(F.lit(None).cast("string").alias(c) for c in ("status", "merge", "bios"))).alias("r"))
    grouped = rows.groupBy("dat_id", game.alias("name")).agg(F.min("row_ord").alias("game_ord"), F.array_sort(F.collect_list(entry)).alias("e"))
    return grouped.select("dat_id", "game_ord", "name", F.transform("e", lambda x: x["r"]).cast(ROM_TYPE).alias("roms"))


def sniff(head: str) -> str:
    """Which reader a catalog needs: game, machine, software, nested or tsv, by its first characters."""
    if re.match(r"\s*(<\?xml|<!DOCTYPE|<)", head):
        for tag, kind in (("<softwarelist", "software"), ("<machine", "machine"), ("<mame", "machine"), ("<game", "game")):
            if tag in head:
                return kind
        return "game"
    return "nested" if _SNIFF.search(head) else "tsv"


def _head(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).limit(200).agg(F.array_join(F.collect_list("value"), "\n")).first()[0] or ""


def is_xml(spark: SparkSession, path: str) -> bool:
    return sniff(_head(spark, path)) in ("game", "machine", "software")


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """The games of one catalog file in whichever format it has."""
    kind = sniff(_head(spark, path))
    if kind == "software":
        return software_games(spark, path)
    return nested_games(spark, path) if kind == "nested" else tsv_games(spark, path) if kind == "tsv" else xml_games(spark, path, kind)


def one_game_per_bios(games: DataFrame) -> DataFrame:
    """Catalogs of exactly one BIOS game with over ten roms: each distinct rom becomes a game of its own."""
    sizes = games.groupBy("dat_id").agg(F.count("*").alias("_n"), F.bool_and("is_bios").alias("_bios"), F.max(F.size("roms")).alias("_roms"))
    rows = games.join(sizes, "dat_id")
    packed = (F.col("_n") == 1) & F.col("_bios") & (F.col("_roms") > 10)
    parts = rows.where(packed).select("*", F.explode(F.array_distinct("roms")).alias("_r")).withColumn("name", F.regexp_replace(F.col("_r.name"), r"\.[^./]*$", "")).withColumn("roms", F.array("_r")).drop("_r")
    return rows.where(~packed).unionByName(parts).drop("_n", "_bios", "_roms")


def keep_catalogs(headers: DataFrame, name: str | None = None, name_not: str | None = None, description: str | None = None, description_not: str | None = None) -> DataFrame:
    """Catalogs whose name and description pass the regexps; those on the description hold only where there is one."""
    ok = F.lit(True)
    if name:
        ok &= F.col("name").rlike(name)
    if name_not:
        ok &= ~F.col("name").rlike(name_not)
    if description:
        ok &= F.coalesce(F.col("description").rlike(description), F.lit(True))
    if description_not:
        ok &= F.coalesce(~F.col("description").rlike(description_not), F.lit(True))
    return headers.where(ok)
