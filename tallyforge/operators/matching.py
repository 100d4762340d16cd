"""Matching catalog rows with files by checksum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import vocab as V

#: Digests from the strongest down; a CRC32 counts with the size.
ALGORITHMS = ["sha256", "sha1", "md5", "crc32"]
#: Bits of the digests, in order of strength.
BITS = {"crc32": 0x1, "md5": 0x10, "sha1": 0x100, "sha256": 0x1000}


def content_key(row: str = "") -> Column:
    """The strongest digest of a row, else its CRC32 and size."""
    c = lambda x: F.col(f"{row}{x}")
    return F.coalesce(c("sha256"), c("sha1"), c("md5"), F.concat_ws("|", c("crc32"), c("size")))


def _pairs(df: DataFrame, suffix: str = "") -> Column:
    """array<struct<strength, algo, key>> of the digests that a row has."""
    out = []
    for i, algo in enumerate(a for a in ALGORITHMS if f"{a}{suffix}" in df.columns):
        key = F.col(f"{algo}{suffix}")
        if algo == "crc32":
            size = f"size{suffix}" if f"size{suffix}" in df.columns else "size"
            key = F.when(key.isNotNull(), F.concat_ws("|", key, F.col(size)))
        out.append(F.when(key.isNotNull(), F.struct(F.lit(len(ALGORITHMS) - ALGORITHMS.index(algo)).alias("strength"), F.lit(algo).alias("algo"), key.alias("key"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def file_keys(files: DataFrame, keep: list[str], suffix: str = "", kind: int | Column = 0) -> DataFrame:
    """``keep``, strength, algo, key, kind: one row per digest of a file. kind is 0 for raw, 1 for headerless, 2 for padded bytes.

    ``suffix`` names another set of digests, as ``_wo`` those without header.
    """
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return files.select(*keep, kind.alias("kind"), F.explode(_pairs(files, suffix)).alias("k")).select(*keep, "k.strength", "k.algo", "k.key", "kind")


def strongest_kind(keys: DataFrame) -> DataFrame:
    """Of each (algo, key) only the least kind: raw bytes before headerless before padded.

    A minimum that is aggregated before the shuffle, joined back: a content
    that a large share of files hold is never sorted in one task.
    """
    least = keys.groupBy("algo", "key").agg(F.min("kind").alias("kind"))
    return keys.join(least, ["algo", "key", "kind"], "left_semi")


def container_rank(container: Column) -> Column:
    out = None
    for i, name in enumerate(V.CONTAINERS):
        out = F.when(container == name, i) if out is None else out.when(container == name, i)
    return out.otherwise(99)


def file_order(prefer: str | None = None, filename_regex: str | None = None, avoid_output: bool = False, can_be_input: str | None = None) -> list[Column]:
    """What files of one content are ordered by; paths by code point at last."""
    out: list[Column] = []
    if can_be_input:
        out.append((~F.col(can_be_input)).cast("int"))
    if prefer:
        plain = F.col("container") == "file"
        out.append((~plain if prefer == "plain" else plain).cast("int"))
    if filename_regex:
        out.append((~F.col("path").rlike(filename_regex)).cast("int"))
    out.append(container_rank(F.col("container")))
    if avoid_output:
        out.append(F.col("in_output").cast("int"))
    return [*out, F.col("path")]


def rank_files(keys: DataFrame, order: list[Column]) -> DataFrame:
    """``keys`` with file_rank from 1 within each (algo, key)."""
    return keys.withColumn("file_rank", F.row_number().over(Window.partitionBy("algo", "key").orderBy(*order)))


def match(roms: DataFrame, keys: DataFrame, rom_id: list[str], order: list[Column]) -> DataFrame:
    """``rom_id``, algo, the columns of ``keys`` and match_rank: all files of every rom, the best first.

    An equi-join on (algo, key) over a row per digest, never a disjunction. Of
    each rom and path only the strongest digest counts; then files are ordered
    by strength and ``order``.
    """
    wanted = roms.select(*rom_id, F.explode(_pairs(roms)).alias("k")).select(*rom_id, "k.algo", "k.key")
    # the order holds the path again, so it is made after the shuffle
    joined = wanted.join(keys, ["algo", "key"]).withColumn("_order", F.struct(*order))
    once = Window.partitionBy(*rom_id, "path").orderBy(F.col("strength").desc(), "_order")
    best = joined.withColumn("_once", F.row_number().over(once)).where("_once = 1").drop("_once")
    rank = F.row_number().over(Window.partitionBy(*rom_id).orderBy(F.col("strength").desc(), "_order"))
    return best.withColumn("match_rank", rank).drop("_order", "key")


def best_match(roms: DataFrame, keys: DataFrame, rom_id: list[str], order: list[Column]) -> DataFrame:
    """The first file of every rom that has one, by a minimum that is aggregated before the shuffle.

    A content that a large share of files holds is so never sorted in one task:
    files of a key are reduced to the best first, then joined.
    """
    value = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*(F.col(c) for c in keys.columns if c not in ("algo", "key", "strength"))).alias("file"))
    top = keys.groupBy("algo", "key").agg(F.min("strength").alias("strength"), F.min(value).alias("best"))
    wanted = roms.select(*rom_id, F.explode(_pairs(roms)).alias("k")).select(*rom_id, "k.algo", "k.key")
    joined = wanted.join(top, ["algo", "key"])
    first = joined.groupBy(*rom_id).agg(F.max_by(F.struct("algo", "best.file"), F.col("strength")).alias("m"))
    return first.select(*rom_id, "m.algo", "m.file.*")


def content_id() -> Column:
    """16 bytes for all digests and the size of a row, which are several times as long."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*ALGORITHMS, "size"]))))


def short_keys(df: DataFrame) -> dict[str, Column]:
    """16 bytes for each digest that ``df`` has, a CRC32 with its size; null where a row lacks it."""
    keys = {a: F.concat_ws("|", a, "size") if a == "crc32" else F.col(a) for a in ALGORITHMS if a in df.columns}
    return {f"_{a}": F.when(F.col(a).isNotNull(), F.unhex(F.md5(key))) for a, key in keys.items()}


def _short_pairs(columns: list[str]) -> Column:
    """A row (strength, key) for each of the short keys that a row has."""
    pairs = [F.when(F.col(f"_{a}").isNotNull(), F.struct(F.lit(len(ALGORITHMS) - i).alias("strength"), F.col(f"_{a}").alias("key"))) for i, a in enumerate(ALGORITHMS) if f"_{a}" in columns]
    return F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def contents(files: DataFrame, by: list[str]) -> DataFrame:
    """id, ``by``, the short keys and best: the contents of ``files`` (id, short keys, value), each once with its least value.

    The least is taken before the shuffle, so what is dealt out is the contents
    and not their files.
    """
    return files.groupBy("id", *by).agg(F.min("value").alias("best"), *(F.first(f"_{a}").alias(f"_{a}") for a in ALGORITHMS if f"_{a}" in files.columns))


def content_matches(roms: DataFrame, found: DataFrame, rom_id: list[str]) -> DataFrame:
    """``rom_id``, id, strength: the contents of every rom, each by the strongest digest that the two share.

    As match(), an equi-join over a row per digest; but of contents, which
    files share, and without what the files are named.
    """
    roms = roms.select(*rom_id, *(c.alias(k) for k, c in short_keys(roms).items()))
    wanted = roms.select(*rom_id, _short_pairs(roms.columns).alias("k")).select(*rom_id, "k.strength", "k.key")
    keys = found.select("id", _short_pairs(found.columns).alias("k")).select("id", "k.strength", "k.key")
    return wanted.join(keys, ["strength", "key"]).groupBy(*rom_id, "id").agg(F.max("strength").alias("strength"))


def empty_files(roms: DataFrame, matched: DataFrame, rom_id: list[str]) -> DataFrame:
    """Rows of ``rom_id`` for the empty roms that no file matched: they can be made from nothing."""
    return roms.where("size = 0").select(*rom_id).join(matched.select(*rom_id).distinct(), rom_id, "left_anti")


def required_checksums(roms: DataFrame, least: str = "crc32", most: str = "sha1") -> DataFrame:
    """One row: the bits of the digests that scanning needs.

    A rom with CRC32 and size needs CRC32, else the first of MD5, SHA-1 and
    SHA-256 that it has; ``least`` is always computed, none above ``most``
    unless a rom has nothing else.
    """
    c = lambda x: F.col(x) if x in roms.columns else F.lit(None)
    bit = F.when(c("crc32").isNotNull() & (F.col("size") > 0), BITS["crc32"]).when(c("md5").isNotNull(), BITS["md5"]).when(c("sha1").isNotNull(), BITS["sha1"]).when(c("sha256").isNotNull(), BITS["sha256"]).otherwise(0)
    return roms.agg(F.coalesce(F.bit_or(bit), F.lit(0)).bitwiseOR(BITS[least]).alias("bits"))


def archives_need_checksums(roms: DataFrame, mode: str = "auto", by: list[str] | None = None) -> DataFrame:
    """A row (for each ``by``): whether archives are hashed as files themselves; auto: if a rom is named like one."""
    named = F.col("name").rlike(r"(?i)\.(7z|cso|dax|gz|gcz|rar|rvz|tar|tgz|wia|z|zip|zipx|zso|chd)$")
    told = F.lit(mode == "always") if mode != "auto" else F.coalesce(F.bool_or(named), F.lit(False))
    return roms.groupBy(*by or []).agg(F.count("*").alias("_n"), told.alias("needed")).drop("_n")


def content_hashes(content: Column) -> list[Column]:
    """size and the four digests of binary content, each an expression of its own, so that unused ones are pruned."""
    body = content.cast("binary")
    return [F.octet_length(body).cast("long").alias("size"), F.lower(F.lpad(F.hex(F.crc32(body)), 8, "0")).alias("crc32"), F.md5(body).alias("md5"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256")]


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of least ``order`` for each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
