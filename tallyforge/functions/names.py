"""What a catalog name says: tags, kind, revision, regions, languages, and names without them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import vocab as V
from tallyforge.functions.text import replace_first

FLAGS = [
    "bios", "device", "aftermarket", "alpha", "alternate", "bad", "beta", "bootleg", "cracked", "debug", "demo", "enhancement_chip", "fixed", "homebrew", "mia",
    "overdump", "pending_dump", "pirated", "program", "prototype", "sample", "translated", "unlicensed", "verified", "bung_fix", "hacked", "trained", "retail",
]
#: Flags that leave a game retail.
_NO_MATTER = {"bios", "device", "alternate", "unlicensed", "verified", "retail"}


def _category(categories: Column, name: str) -> Column:
    return F.coalesce(F.exists(categories, lambda c: F.lower(c) == name), F.lit(False))


def flags(name: Column, categories: Column, manufacturer: Column, bios: Column, device: Column) -> dict[str, Column]:
    """A boolean for each of FLAGS, never null."""
    tag = lambda key: name.rlike(V.TAGS[key])
    maker = F.lower(F.coalesce(manufacturer, F.lit("")))
    verified = F.contains(name, F.lit("[!]"))
    out = {
        "bios": F.coalesce(bios, F.lit(False)) | tag("bios"),
        "device": F.coalesce(device, F.lit(False)),
        "bad": tag("bad") | (~verified & (F.contains(name, F.lit("[c]")) | F.contains(name, F.lit("[x]")))),
        "bootleg": F.contains(maker, F.lit("bootleg")),
        "demo": tag("demo") | _category(categories, "demos"),
        "pending_dump": F.contains(name, F.lit("[!p]")),
        "pirated": tag("pirated_paren") | tag("pirated_bracket"),
        "program": tag("program") | _category(categories, "applications"),
        "prototype": tag("prototype") | _category(categories, "preproduction"),
        "verified": verified,
        "hacked": tag("hack_paren") | tag("hack_bracket") | F.contains(maker, F.lit("hack")),
        "trained": tag("trainer"),
    }
    out |= {k: tag(k) for k in FLAGS if k not in out and k != "retail"}
    out["retail"] = retail(out)
    return {k: out[k] for k in FLAGS}


def retail(flag: dict[str, Column]) -> Column:
    """None of the flags that a retail game cannot have."""
    return ~_any(flag[k] for k in FLAGS if k not in _NO_MATTER)


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def game_type(flag: dict[str, Column]) -> Column:
    """The first kind that applies: BIOS, then retail if verified, then by GAME_TYPES, else retail."""
    out = F.when(flag["bios"], "BIOS").when(flag["verified"], "Retail")
    for kind in V.GAME_TYPES:
        out = out.when(flag[kind.lower()], kind.replace("_", " "))
    return out.otherwise("Retail")


def revision(name: Column) -> Column:
    """Number, letter (A is 1), version or ring code (1 if bare) of a name, else 0; a number that is none counts as 0."""
    number, letter = F.regexp_extract(name, V.REVISION_NUMBER, 2), F.upper(F.regexp_extract(name, V.REVISION_LETTER, 1))
    version, ring = F.regexp_extract(name, V.VERSION, 1), F.regexp_extract(name, V.RING_CODE, 1)
    numeric = lambda c: F.when(c.rlike(r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), c.cast("double")).otherwise(F.lit(0.0))
    return (
        F.when(name.rlike(V.REVISION_NUMBER), numeric(number))
        .when(name.rlike(V.REVISION_LETTER), (F.ascii(letter) - 64).cast("double"))
        .when(name.rlike(V.VERSION), numeric(version))
        .when(name.rlike(V.RING_CODE), F.when(ring == "", F.lit(1.0)).otherwise(ring.cast("double")))
        .otherwise(F.lit(0.0))
    )


def regions(name: Column, override: Column | None = None, releases: Column | None = None) -> Column:
    """Region codes: the override, names in the name, its first short code, the releases' regions, or none."""
    by_name = F.create_map(*(F.lit(x) for code, long, _, _ in V.REGIONS for x in (long.lower(), code)))
    long = F.regexp_extract(name, V.LONG_REGIONS, 1)
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    if override is not None:
        out = out.when(override.isNotNull(), F.array(override))
    out = out.when(long != "", F.transform(F.split(F.lower(long), ", ?"), lambda x: F.element_at(by_name, x)))
    for code, _, _, pattern in V.REGIONS:
        if pattern:
            out = out.when(name.rlike(pattern), F.array(F.lit(code)))
    rest = F.array().cast("array<string>") if releases is None else F.transform(F.coalesce(releases, F.array().cast("array<string>")), F.upper)
    return out.otherwise(rest)


def languages(name: Column, found_regions: Column, override: Column | None = None, releases: Column | None = None) -> Column:
    """Two-letter languages: the override, codes in the name, the releases' languages, those of the regions, or none."""
    known = F.array(*map(F.lit, V.LANGUAGES))
    two = F.regexp_replace(F.regexp_extract(name, V.TWO_LETTERS, 1), "-[a-zA-Z]+$", "")
    two = F.array_distinct(F.filter(F.split(F.upper(two), "[,+]"), lambda x: F.array_contains(known, x)))
    long = F.create_map(*(F.lit(x) for pair in V.LONG_LANGUAGES.items() for x in pair))
    three = F.transform(F.split(F.upper(F.regexp_extract(name, V.THREE_LETTERS, 1)), "-"), lambda x: F.element_at(long, x))
    three = F.array_distinct(F.filter(three, lambda x: x.isNotNull()))
    spoken = F.create_map(*(F.lit(x) for code, _, language, _ in V.REGIONS for x in (code, language)))
    by_region = F.filter(F.transform(found_regions, lambda r: F.element_at(spoken, r)), lambda x: x.isNotNull())
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    if override is not None:
        out = out.when(override.isNotNull(), F.array(override))
    out = out.when(F.size(two) > 0, two).when(F.size(three) > 0, three)
    if releases is not None:
        told = F.filter(F.coalesce(releases, F.array().cast("array<string>")), lambda x: x.isNotNull())
        out = out.when(F.size(told) > 0, told)
    return out.otherwise(by_region)


def _stripper(rules: list[tuple[str, str, int]]):
    """A function of a column of names: each (pattern, replacement, most matches) in order, then spaces collapsed.

    As expressions, so many replacements are more code than one compiled method
    may have; in Arrow batches they cost a pass over the distinct names.
    """

    def strip(names: pd.Series) -> pd.Series:
        compiled = [(re.compile(p, re.ASCII), by, most) for p, by, most in rules]
        known: dict[str | None, str | None] = {None: None}
        for name in names.dropna().unique():
            out = name
            for pattern, by, most in compiled:
                out = pattern.sub(by, out, count=most)
            known[name] = re.sub(r"^\s+|\s+$", "", re.sub("  +", " ", out), flags=re.ASCII)
        return names.map(known)

    return F.pandas_udf(strip, "string")


def strip_region_language(name: Column) -> Column:
    return _stripper([(p, "", 1) for p in V.REGION_LANGUAGE_TAGS])(name)


def strip_variants(name: Column) -> Column:
    group = lambda by: re.sub(r"\{(\d+)\}", r"\\g<\1>", by)
    return _stripper([(p, group(by), 0 if p in V.ALL_MATCHES else 1) for p, by in V.VARIANT_TAGS])(name)


def strip_track(name: Column) -> Column:
    for pattern in V.TRACK_TAGS:
        name = replace_first(name, pattern)
    return name


def strip_disc(name: Column) -> Column:
    for pattern in V.DISC_TAGS:
        name = replace_first(name, pattern)
    return name
