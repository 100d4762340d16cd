"""Writers of reports, catalogs and playlists, and the carrying out of write plans."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import os
import shutil
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import catalog_filename
from tallyforge.operators.reports import REPORT_COLUMNS


def write_report(rows: DataFrame, path: str) -> None:
    """``report_rows`` as CSV files in their order; the header line is in each."""
    rows.orderBy("section", "sort_key").select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def reported(rows: DataFrame, by: str = "dat_id") -> DataFrame:
    """Rows of catalogs with a found game; all rows if none has one, which a small job finds out first."""
    found = rows.where("status = 'FOUND'").select(by).distinct()
    return rows.join(found, by, "left_semi") if found.head(1) else rows


def catalog_header(name: str, description: str, version: str, options: dict | None = None) -> str:
    """The header element of a written catalog; options that made it stand in its comment as JSON."""
    comment = json.dumps(options or {}, sort_keys=True, default=sorted)
    parts = [("name", name), ("description", description), ("version", version), ("comment", comment)]
    return "  <header>\n" + "".join(f"    <{k}>{_escape(v)}</{k}>\n" for k, v in parts) + "  </header>\n"


def _escape(v: str) -> str:
    return v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def game_xml(games: DataFrame) -> Column:
    """One ``<game>`` element per row of name, clone_of, description and roms (array of structs); null attributes are left out."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), escaped(c), F.lit('"'))).otherwise("")
    fields = [f for f in ("name", "size", "crc32", "md5", "sha1", "sha256", "status", "merge") if f in games.schema["roms"].dataType.elementType.names]
    rom = lambda r: F.concat(F.lit("    <rom"), *(attribute("crc" if f == "crc32" else f, r[f]) for f in fields), F.lit("/>\n"))
    return F.concat(
        F.lit("  <game"), attribute("name", F.col("name")), attribute("cloneof", F.col("clone_of")), F.lit(">\n    <description>"), escaped(F.coalesce("description", "name")), F.lit("</description>\n"), F.array_join(F.transform("roms", rom), ""), F.lit("  </game>\n")
    )


def catalog_rows(games: DataFrame, by: str = "dat_name") -> DataFrame:
    """``by``, file_name, game_ord and xml: a row per game of a written catalog; parents that are not there are not named."""
    known = games.select(by, F.col("name").alias("clone_of")).distinct().withColumn("_there", F.lit(True))
    rows = games.join(known, [by, "clone_of"], "left").withColumn("clone_of", F.when(F.col("_there"), F.col("clone_of")))
    return rows.select(by, catalog_filename(F.col(by), F.lit(None).cast("string")).alias("file_name"), "game_ord", game_xml(rows).alias("xml"))


def catalog_texts(games: DataFrame, by: str = "dat_name") -> DataFrame:
    """file_name and body of a written catalog per ``by``, for catalogs that fit in one row; ``write_catalogs`` has no such bound."""
    rows = catalog_rows(games, by)
    texts = rows.groupBy(by, "file_name").agg(F.array_sort(F.collect_list(F.struct("game_ord", "xml"))).alias("g"))
    return texts.select(by, "file_name", F.array_join(F.transform("g", lambda g: g["xml"]), "").alias("body"))


def write_catalogs(games: DataFrame, folder: str, by: str = "dat_name", options: dict | None = None) -> list[str]:
    """Catalog files below ``folder``, one per ``by``; each is streamed game by game by the task that has it, and none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for name, same in itertools.groupby(rows, key=lambda r: r["file_name"]):
            first = next(same)
            path = os.path.join(folder, name)
            os.makedirs(folder, exist_ok=True)
            temporary = f"{path}.{os.getpid()}.part"
            write_catalog(temporary, catalog_header(first["dat"], first["dat"], "", options), (r["xml"] for r in itertools.chain([first], same)))
            os.replace(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    rows = catalog_rows(games, by).select(F.col(by).cast("string").alias("dat"), "file_name", "game_ord", "xml")
    done = rows.repartition("file_name").sortWithinPartitions("file_name", "game_ord").mapInArrow(run, "path string")
    return sorted(r["path"] for r in done.collect())  # a row per catalog


def write_catalog(path: str, header: str, bodies: Iterable[str]) -> None:
    """A catalog file on the driver, game by game."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0"?>\n<datafile>\n' + header)
        for body in bodies:
            f.write(body)
        f.write("</datafile>\n")


def playlist_text(entries: Column) -> Column:
    return F.concat(F.array_join(entries, "\n"), F.lit("\n"))


def torrentzip(entries: list[tuple[str, bytes]]) -> bytes:
    """A zip in the structured form: names in caseless order, fixed times and flags, and a comment with the directory's CRC.

    The compressed bytes are this zlib's, so tools that demand another zlib's
    bytes may rebuild it.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name, body in sorted(entries, key=lambda e: (e[0].lower(), e[0])):
            info = zipfile.ZipInfo(name, (1996, 12, 24, 23, 32, 0))
            info.compress_type, info.create_system, info.external_attr, info.flag_bits = zipfile.ZIP_DEFLATED, 0, 0, 2
            z.writestr(info, body)
    body = out.getvalue()
    at = body.rindex(b"PK\x05\x06")
    size, start = struct.unpack("<II", body[at + 12 : at + 20])
    comment = f"TORRENTZIPPED-{zlib.crc32(body[start : start + size]):08X}".encode()
    return body[: at + 20] + struct.pack("<H", len(comment)) + comment


def is_torrentzip(body: bytes) -> bool:
    """Whether a zip's comment has the CRC of its directory and its names are in caseless order."""
    at = body.rfind(b"PK\x05\x06")
    if at < 0 or len(body) < at + 22:
        return False
    size, start, n = struct.unpack("<IIH", body[at + 12 : at + 22])
    if body[at + 22 : at + 22 + n] != f"TORRENTZIPPED-{zlib.crc32(body[start : start + size]):08X}".encode():
        return False
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
    return names == sorted(names, key=lambda x: (x.lower(), x))


def carry_out(plan: Iterable[dict], mode: str = "copy", retries: int = 2) -> list[dict]:
    """Copies, moves or links each {path, out_path, action, sha1} of a plan; returns what was done.

    With an ``entry``, that entry of the archive at ``path`` is written. Files
    are written beside their place and renamed; a wrong SHA-1 afterwards is
    tried again. ``test`` rewrites only what is not right.
    """
    done = []
    for row in plan:
        action = row["action"]
        if action == "test":
            action = "skip" if _sha1(row["out_path"]) == row.get("sha1") else "overwrite"
        error = None
        for _ in range(0 if action == "skip" else retries + 1):
            try:
                if row.get("entry"):
                    _fill(row["out_path"], read_entry(row["path"], row["entry"], row["container"]))
                else:
                    _place(row["path"], row["out_path"], mode)
                error = "checksum" if row.get("sha1") and _sha1(row["out_path"]) != row["sha1"] else None
            except (OSError, KeyError, zipfile.BadZipFile, tarfile.TarError) as e:
                error = str(e)
            if not error:
                break
        done.append({**row, "done": action, "error": error})
    for row in done if mode == "move" else []:
        if not row["error"] and not row.get("entry") and row["done"] != "skip" and os.path.exists(row["path"]):
            os.remove(row["path"])
    return done


def zip_together(rows: list[dict]) -> list[dict]:
    """Writes one structured zip of the rows {path, entry, container, out_path, out_entry, action}, unless it is to be skipped."""
    out = rows[0]["out_path"]
    if rows[0]["action"] == "skip":
        return [{**r, "done": "skip", "error": None} for r in rows]
    try:
        bodies = {r["out_entry"]: read_entry(r["path"], r["entry"], r["container"]) for r in rows}
        _fill(out, torrentzip(sorted(bodies.items())))
        error = None
    except (OSError, KeyError, zipfile.BadZipFile, tarfile.TarError) as e:
        error = str(e)
    return [{**r, "done": rows[0]["action"], "error": error} for r in rows]


def write_outputs(plan: DataFrame, mode: str = "copy", retries: int = 2) -> DataFrame:
    """out_path, done, error for every row of a plan (path, entry, container, out_path, out_entry, action), carried out by the tasks.

    All rows of one output go to one task, in order. Inputs and outputs are in
    a file system that all executors mount. A task that is run again writes the
    same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, same in itertools.groupby(rows, key=lambda r: r["out_path"]):
            same = list(same)
            done = zip_together(same) if same[0]["out_entry"] else carry_out(same, mode, retries)
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("out_path", "done", "error")} for r in done], pa.schema([(k, pa.string()) for k in ("out_path", "done", "error")]))

    columns = ["path", "entry", "container", "out_path", "out_entry", "action"]
    dealt = plan.select(*columns).repartition("out_path").sortWithinPartitions("out_path", "out_entry", "path")
    return dealt.mapInArrow(run, "out_path string, done string, error string")


def read_entry(path: str, entry: str | None, container: str) -> bytes:
    """The bytes of a file, or of an entry of a zip, tar or gzip."""
    if entry is None:
        with open(path, "rb") as f:
            return f.read()
    if container == "zip":
        with zipfile.ZipFile(path) as z:
            names = {i.filename.replace("\\", "/"): i for i in z.infolist()}
            return z.read(names[entry])
    try:
        with tarfile.open(path) as t:
            return next(t.extractfile(i).read() for i in t if i.isfile() and i.name.replace("\\", "/") == entry)
    except (tarfile.TarError, StopIteration):
        with gzip.open(path) as f:
            return f.read()


def _fill(out: str, body: bytes) -> None:
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    temporary = f"{out}.{os.getpid()}.part"
    with open(temporary, "wb") as f:
        f.write(body)
    os.replace(temporary, out)


def _sha1(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha1").hexdigest()
    except OSError:
        return None


def _place(path: str, out: str, mode: str) -> None:
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    temporary = f"{out}.{os.getpid()}.part"
    if mode in ("copy", "move"):
        shutil.copyfile(path, temporary)
    elif mode == "hardlink":
        os.link(path, temporary)
    else:
        os.symlink(os.path.relpath(path, os.path.dirname(out)) if mode == "relative" else os.path.abspath(path), temporary)
    os.replace(temporary, out)


def clean(paths: Iterable[str], backup: str | None = None, dry_run: bool = False, root: str | None = None) -> list[str]:
    """Deletes files, or moves them to ``backup``, then folders below ``root`` that are empty, the deepest first."""
    gone = []
    for path in paths:
        gone.append(path)
        if dry_run:
            continue
        if backup:
            # below the backup as below the root, so that equal names do not meet
            place = os.path.join(backup, os.path.relpath(path, root) if root and not os.path.relpath(path, root).startswith("..") else os.path.basename(path))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            shutil.move(path, place)
        else:
            os.remove(path)
    for folder, _, _ in sorted(os.walk(root), key=lambda x: -x[0].count(os.sep)) if root and not dry_run else ():
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)
    return gone
