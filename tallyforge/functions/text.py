"""String helpers of the engine as Column functions, and driver-side translations of globs, regexps and dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_first(c: Column, pattern: str, by: str = "") -> Column:
    """Replaces only the first match; ``{n}`` in ``by`` is the pattern's n-th group."""
    target = re.sub(r"\{(\d+)\}", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(c, rf"(?s)^(.*?)(?:{pattern})", "$1" + target)


def replace_literal_first(c: Column, token: str, by: Column) -> Column:
    """The first occurrence of a literal text, replaced by a column; where that is null the text stays."""
    quoted = F.regexp_replace(F.coalesce(by, F.lit(token)), r"([\\$])", r"\\$1")
    return F.regexp_replace(c, F.lit(r"(?s)^(.*?)" + re.escape(token)), F.concat(F.lit("$1"), quoted))


def collapse(c: Column) -> Column:
    """Runs of spaces become one; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(c, "  +", " "), r"^\s+|\s+$", "")


def hex_key(c: Column, width: int) -> Column:
    """A checksum in lower case, without ``0x``, padded with zeros to ``width``; longer values stay whole."""
    bare = F.regexp_replace(F.lower(c), "^0x", "")
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def well_formed(c: Column, width: int) -> Column:
    """The checksum if it has ``width`` hex digits, else null."""
    return F.when(c.rlike(f"^[0-9a-f]{{{width}}}$"), c)


def make_legal(c: Column) -> Column:
    """A path that every file system takes: ``:`` becomes ``;``, other forbidden characters ``_``, separators ``/``."""
    return F.translate(F.regexp_replace(F.translate(c, ":", ";"), r"[<>\"|?*]", "_"), "\\", "/")


def readable_size(c: Column) -> Column:
    """Bytes with their unit by powers of 1024: whole numbers as they are, else three digits at most."""
    units = F.array(*map(F.lit, ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]))
    step = F.lit(0)
    for i in range(1, 7):
        step = F.when(c >= 1024**i, i).otherwise(step)
    value = c / F.pow(F.lit(1024.0), step)
    one = F.format_string("%.1f", value)
    shown = (
        F.when(value == F.floor(value), F.format_string("%.0f", value))
        .when(value < 10, F.format_string("%.2f", value))
        .when((value >= 100) | (F.length(one) >= 5), F.format_string("%.0f", value))
        .otherwise(one)
    )
    return F.concat(shown, F.get(units, step))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """The path before the last separator; ``.`` without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """From the last dot of the base name, the dot included; empty without one."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def name_without_extensions(path: Column) -> Column:
    """The base name without its trailing extensions of small letters and digits."""
    return F.trim(F.regexp_replace(basename(path), r"(\.[a-z0-9]+)+$", ""))


def crc_in_name(path: Column) -> Column:
    """The first eight hex digits that stand alone in a patch's file name, in lower case; null if none."""
    found = F.regexp_extract(basename(path), r"(?i)(^|[^a-z0-9])(0x)?([a-f0-9]{8})([^a-z0-9]|$)", 3)
    return F.when(found != "", F.lower(found))


def patched_name(path: Column) -> Column:
    """A patch's file name without its extension and without its CRC wherever that occurs."""
    crc = F.coalesce(crc_in_name(path), F.lit("(?!)"))
    return collapse(F.regexp_replace(stem(path), F.concat(F.lit("(?i)"), crc), F.lit("")))


def display_name(name: Column) -> Column:
    """A catalog's name without doubled or outer dashes and spaces."""
    inner = F.regexp_replace(F.trim(name), "-( +-)+", "- ")
    return collapse(F.regexp_replace(F.regexp_replace(inner, "^[ -]+", ""), "[ -]+$", ""))


def catalog_filename(name: Column, version: Column) -> Column:
    shown = F.when(F.coalesce(version, F.lit("")) != "", F.concat(name, F.lit(" ("), version, F.lit(")"))).otherwise(name)
    return make_legal(F.trim(F.concat(shown, F.lit(".dat"))))


def regex_list(text: str) -> str | None:
    """One Java regexp for lines of plain patterns or ``/pattern/flags``; null if there is none."""
    out = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        m = re.fullmatch(r"/(.+)/([a-z]*)", line)
        flags = "".join(x for x in (m[2] if m else "") if x in "ims")
        out.append(f"(?:(?{flags}){m[1] if m else line})" if flags else f"(?:{m[1] if m else line})")
    return "|".join(out) or None


def glob_regex(glob: str) -> str:
    """An anchored regexp for a glob with ``*``, ``**``, ``?``, ``[...]`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def escape_glob(path: str) -> str:
    """A path with the characters that Hadoop's globs read escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


# Date tokens of report names and their strftime forms, longest first.
DATE_TOKENS = {"YYYY": "%Y", "YY": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "DD": "%d", "dddd": "%A", "ddd": "%a", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "SSS": "%f", "A": "%p", "ZZ": "%z"}


def format_dates(name: str, at: dt.datetime) -> str:
    """``%TOKEN`` in a file name replaced by that part of the time."""

    def part(m: re.Match[str]) -> str:
        shown = at.strftime(DATE_TOKENS[m[1]])
        return shown[:3] if m[1] == "SSS" else shown

    return re.sub("%(" + "|".join(sorted(DATE_TOKENS, key=len, reverse=True)) + ")", part, name)
