"""Output paths as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import basename, dirname, extension, make_legal, replace_literal_first, stem


def replace_tokens(path: Column, tokens: dict[str, Column]) -> Column:
    """``{token}`` replaced once each, in order; a null value leaves its token."""
    for name, value in tokens.items():
        path = replace_literal_first(path, "{" + name + "}", value)
    return path


def game_tokens(basename_: Column | None = None, input_path: Column | None = None) -> dict[str, Column]:
    """Tokens of a game's row (region, language, game_type, genre, category, dat_name, dat_description) and of its files."""
    slashless = lambda c: F.regexp_replace(F.col(c), r"[\\/]", "_")
    out = {k: F.nullif(F.col(c), F.lit("")) for k, c in (("region", "region"), ("language", "language"), ("type", "game_type"), ("genre", "genre"), ("category", "category"))}
    out |= {"datName": slashless("dat_name"), "datDescription": F.nullif(slashless("dat_description"), F.lit(""))}
    if input_path is not None:
        out["inputDirname"] = dirname(input_path)
    if basename_ is not None:
        ext = F.regexp_replace(extension(basename_), r"^\.", "")
        out |= {"outputBasename": basename(basename_), "outputName": stem(basename_), "outputExt": F.when(ext == "", "-").otherwise(ext)}
    return out


def console_tokens(df: DataFrame, path: str, consoles: list[tuple[str, list[str], dict[str, str]]], dat_name: str, ext: str) -> DataFrame:
    """``path`` with the tokens of the last console whose regexp finds the catalog's name, else of the last with the extension.

    ``consoles``: regexp, extensions and tokens of each, in order; reference
    data of a row per console, so it stands in the plan.
    """
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    tokens = lambda t: F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in t.items())).cast("array<struct<key:string,value:string>>")
    listed = F.array(*(F.struct(F.lit(regex).alias("dat_regex"), texts([e.lower() for e in extensions]).alias("extensions"), tokens(t).alias("tokens")) for regex, extensions, t in consoles))
    rows = df.withColumn("_consoles", listed)
    named = F.filter("_consoles", lambda c: F.rlike(F.col(dat_name), c["dat_regex"]))
    alike = F.filter("_consoles", lambda c: F.array_contains(c["extensions"], F.lower(F.col(ext))))
    chosen = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(alike, F.lit(-1)))
    rows = rows.withColumn("_chosen", chosen)
    replaced = F.aggregate(F.col("_chosen.tokens"), F.col(path), lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"^(.*?)\{"), e["key"], F.lit(r"\}")), F.concat(F.lit("$1"), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"))))
    return rows.withColumn(path, F.coalesce(replaced, F.col(path))).drop("_consoles", "_chosen")


def has_leftover(path: Column) -> Column:
    """A token that nothing replaced: the candidate is dropped."""
    return path.rlike(r"\{[a-zA-Z]+\}")


def output_root(output: str) -> str:
    """The part of an output path before its first token."""
    parts = output.split("/")
    for i, part in enumerate(parts):
        if "{" in part:
            return "/".join(parts[:i]) or "."
    return output


def mirror(path: Column, roots: list[str]) -> Column:
    """The folder of an input below the input path that holds it."""
    for root in roots:
        root = root.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    return dirname(path)


def join_path(*parts: Column) -> Column:
    """Parts joined by ``/``; null, empty and ``.`` parts are left out."""
    return make_legal(F.concat_ws("/", *(F.when((p != "") & (p != "."), p) for p in parts)))


def letters(name: Column, count: int = 1, grouped: bool = False) -> Column:
    """The first letters of a name in upper case, padded with A; others become ``#``, digits too unless grouped."""
    first = F.upper(F.rpad(F.substring(name, 1, count), count, "A"))
    first = F.regexp_replace(first, "[^A-Z0-9]", "#")
    return first if grouped else F.regexp_replace(first, "[^A-Z]", "#")


def letter_dirs(names: DataFrame, count: int = 1, limit: int | None = None, grouped: bool = False, name: str = "name") -> DataFrame:
    """``names`` (dat_id, ``name``) with dir: its letter folder.

    ``name`` may be ``folder/file``; all of a folder stay together, as one
    sub-path. Without limit and groups the folder follows from the name, and
    nothing is joined. With a limit, a letter of more sub-paths is cut into A1, A2 and
    so on. Grouped, whole letters are packed in order into folders of at most
    ``limit`` sub-paths, named A-C; a letter that is too long by itself is cut.
    Only counts per letter, of which there are 37 to the power of ``count`` at
    most, are folded in order.
    """
    letter = letters(F.when(F.instr(name, "/") > 0, dirname(F.col(name))).otherwise(stem(F.col(name))), count, grouped)
    if not grouped and not limit:
        return names.withColumn("dir", letter)
    rows = names.withColumns({"sub": F.regexp_replace(name, "[/].+$", ""), "letter": letter})
    subs = rows.select("dat_id", "letter", "sub").distinct()
    if grouped:
        counts = subs.groupBy("dat_id", "letter").agg(F.count("*").alias("n"))
        runs = counts.groupBy("dat_id").agg(F.array_sort(F.collect_list(F.struct("letter", "n"))).alias("runs"))
        most = limit or 1 << 62
        kind = "struct<folder:int,used:bigint,out:array<struct<letter:string,folder:int>>>"
        folded = F.aggregate(
            "runs",
            F.struct(F.lit(0).alias("folder"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<letter:string,folder:int>>").alias("out")).cast(kind),
            lambda acc, r: F.when(
                (acc["used"] > 0) & (acc["used"] + r["n"] > most),
                F.struct((acc["folder"] + 1).alias("folder"), r["n"].alias("used"), F.array_append(acc["out"], F.struct(r["letter"].alias("letter"), (acc["folder"] + 1).alias("folder"))).alias("out")),
            )
            .otherwise(F.struct(acc["folder"].alias("folder"), (acc["used"] + r["n"]).alias("used"), F.array_append(acc["out"], F.struct(r["letter"].alias("letter"), acc["folder"].alias("folder"))).alias("out")))
            .cast(kind),
            lambda acc: acc["out"],
        )
        placed = runs.select("dat_id", F.explode(folded).alias("f")).select("dat_id", "f.letter", "f.folder")
        spans = placed.groupBy("dat_id", "folder").agg(F.min("letter").alias("a"), F.max("letter").alias("b"))
        named = placed.join(spans, ["dat_id", "folder"]).select("dat_id", "letter", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("-", "a", "b")).alias("dir"))
        subs = subs.join(named, ["dat_id", "letter"])
    else:
        subs = subs.withColumn("dir", F.col("letter"))
    if limit:
        group = Window.partitionBy("dat_id", "dir")
        at, n = F.row_number().over(group.orderBy("sub")), F.count("*").over(group)
        subs = subs.select("dat_id", "letter", "sub", F.when(n > limit, F.concat("dir", F.floor((at - 1) / limit) + 1)).otherwise(F.col("dir")).alias("dir"))
    return rows.join(subs.select("dat_id", "letter", "sub", "dir"), ["dat_id", "letter", "sub"]).drop("letter", "sub")


def in_game_dir(name: Column, game: Column, rom: Column, mode: str, several: Column, archive: Column, merged_disc: Column) -> Column:
    """The file under a folder named like its game: always, or for games of several files, and for merged discs."""
    if mode == "always":
        return F.concat_ws("/", game, name)
    nested = game.rlike(r"[\\/]") & rom.rlike(r"[\\/]")
    wanted = merged_disc if mode == "never" else merged_disc | (several & ~nested & ~archive)
    return F.when(wanted, F.concat_ws("/", game, name)).otherwise(name)


def rom_basename(rom: Column, disk: Column, headerless_ext: Column) -> Column:
    """A rom's own file name; disks end in .chd, headered roms in their headerless extension."""
    swapped = F.when(headerless_ext.isNotNull() & rom.rlike(r"[^/.][^/]*\.[^/.]*$"), F.concat(F.regexp_replace(rom, r"\.[^/.]*$", ""), headerless_ext)).otherwise(rom)
    return F.when(disk, F.concat(F.regexp_replace(rom, r"(?i)\.chd$", ""), F.lit(".chd"))).otherwise(swapped)


def output_basename(game: Column, rom_file: Column, input_path: Column, zipped: Column, kept_archive: Column) -> Column:
    """``game.zip`` when zipped, the game's name with the input's extensions when an archive is kept, else the rom's file name."""
    old = F.regexp_extract(input_path, r"[^.]+((?:\.[a-zA-Z0-9]+)+)$", 1)
    inner = F.regexp_replace(old, r"\.[^.]*$", "")
    doubled = (inner != "") & F.endswith(game, inner)
    kept = F.when(doubled, F.concat(F.substring(game, F.lit(1), F.length(game) - F.length(inner)), old)).otherwise(F.concat(game, old))
    return F.when(zipped, F.concat(game, F.lit(".zip"))).when(kept_archive, kept).otherwise(rom_file)
