"""Files and the entries of archives, with their digests."""

from __future__ import annotations

import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import basename, escape_glob
from tallyforge.operators.matching import BITS, content_hashes
from tallyforge.sources.signatures import detect

ENTRY = "path string, entry string, container string, size long, crc32 string, md5 string, sha1 string, sha256 string, supported boolean"
# Extensions of containers, longest first, and what they hold.
EXTENSIONS = {".tar.gz": "tar", ".nkit.iso": "nkit", ".tgz": "tar", ".tar": "tar", ".zip": "zip", ".gz": "gzip", ".chd": "chd", ".rar": "rar", ".7z": "7z", ".z": "7z", ".z01": "7z", ".zipx": "7z", ".cso": "cso", ".dax": "cso", ".zso": "cso", ".gcz": "dolphin", ".rvz": "dolphin", ".wia": "dolphin"}
#: Containers whose entries can be read here.
READABLE = {"zip", "tar", "gzip", "chd", "nkit"}
#: Bytes that are hashed at once; entries are unpacked in such pieces and never held whole.
PIECE = 1 << 16
#: Bits of the digests that a scan can be asked for, as ``required_checksums`` gives them.
EVERY = sum(BITS.values())
# Names of files that operating systems and editors leave behind.
JUNK = r"^(npm-debug\.log|\..*\.swp|\.DS_Store|\.AppleDouble|\.LSOverride|Icon\r|\._.*|\.Spotlight-V100|\.Trashes|__MACOSX|Thumbs\.db|ehthumbs\.db|[Dd]esktop\.ini)$|~$|@eaDir$"


def container_of(path: str, head: bytes) -> str:
    """By extension, or by the first bytes where those tell another container; ``file`` for all else."""
    low = path.lower()
    by_name = next((kind for ext, kind in EXTENSIONS.items() if low.endswith(ext)), None)
    told = detect(head)
    by_bytes = EXTENSIONS.get(told or "")
    if by_name and (by_bytes in (None, by_name) or by_name in ("tar", "7z")):
        return by_name
    return by_bytes or "file"


def _sums(source: BinaryIO | bytes, bits: int = EVERY) -> tuple[int, str | None, str | None, str | None, str | None]:
    """Size and the digests that ``bits`` asks for, in one pass over pieces."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    size, crc = 0, 0
    digests = {name: hashlib.new(name) for name in ("md5", "sha1", "sha256") if bits & BITS[name]}
    while piece := source.read(PIECE):
        size += len(piece)
        if bits & BITS["crc32"]:
            crc = zlib.crc32(piece, crc)
        for d in digests.values():
            d.update(piece)
    told = {name: d.hexdigest() for name, d in digests.items()}
    return size, f"{crc:08x}" if bits & BITS["crc32"] else None, told.get("md5"), told.get("sha1"), told.get("sha256")


def _zip(body: bytes, quick: bool, bits: int) -> Iterator[tuple]:
    """Where the CRC32 is all that is asked for, the directory's is taken and nothing is unpacked."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name = info.filename.replace("\\", "/")
            if quick or not bits & ~BITS["crc32"]:
                yield name, info.file_size, f"{info.CRC:08x}", None, None, None
            else:
                with z.open(info) as source:
                    yield name, *_sums(source, bits)


def _tar(body: bytes, quick: bool, bits: int) -> Iterator[tuple]:
    """A quick scan tells names and sizes only, as a tar has no checksums."""
    with tarfile.open(fileobj=io.BytesIO(body)) as t:
        for info in t:
            if info.isfile():
                yield info.name.replace("\\", "/"), *((info.size, None, None, None, None) if quick else _sums(t.extractfile(info), bits))


def _gzip(body: bytes, quick: bool, path: str, bits: int) -> Iterator[tuple]:
    try:
        yield from list(_tar(body, quick, bits))
        return
    except (tarfile.TarError, OSError, EOFError, zlib.error):
        pass
    name = path.rsplit("/", 1)[-1].removesuffix(".gz")
    if body[3] & 8:
        at = 10 + (2 + struct.unpack("<H", body[10:12])[0] if body[3] & 4 else 0)
        name = body[at : body.index(b"\0", at)].decode("latin-1")
    if quick:
        crc, size = struct.unpack("<II", body[-8:])
        yield name, size, f"{crc:08x}", None, None, None
    else:
        with gzip.open(io.BytesIO(body)) as source:
            yield name, *_sums(source, bits)


def _chd(body: bytes, quick: bool, path: str) -> Iterator[tuple]:
    """Version 5: the SHA-1 of data and metadata together (size 0), and that of the data with its size unless it is a disc."""
    if body[:8] != b"MComprHD" or struct.unpack(">I", body[12:16])[0] != 5:
        return
    size, meta = struct.unpack(">QQ", body[32:40] + body[48:56])
    raw, whole = body[64:84].hex(), body[84:104].hex()
    name = path.rsplit("/", 1)[-1]
    yield name, 0, None, None, whole, None
    if body[meta : meta + 3] not in (b"CHT", b"CHC", b"CHG"):
        yield name, size, None, None, raw, None


def _nkit(body: bytes, path: str) -> Iterator[tuple]:
    if body[0x200:0x204] == b"NKIT":
        crc, size = struct.unpack(">II", body[0x208:0x20C] + body[0x210:0x214])
        yield path.rsplit("/", 1)[-1].replace(".nkit", ""), size, f"{crc:08x}", None, None, None


def entries_of(path: str, body: bytes, quick: bool = False, bits: int = EVERY, itself: bool = False) -> list[tuple]:
    """(entry, container, size, crc32, md5, sha1, sha256, supported) of a file: itself, or what it contains.

    ``itself``: an archive also gives a row of its own bytes. One that cannot
    be read gives only that row, with supported false, so it is not lost.
    """
    kind = container_of(path, body)
    whole = lambda supported: (None, kind, *_sums(body, bits), supported)
    if kind == "file":
        return [whole(True)]
    if kind not in READABLE:
        return [whole(False)]
    read = {"zip": lambda: _zip(body, quick, bits), "tar": lambda: _tar(body, quick, bits), "gzip": lambda: _gzip(body, quick, path, bits), "chd": lambda: _chd(body, quick, path), "nkit": lambda: _nkit(body, path)}
    try:
        found = [(name, kind, *rest, True) for name, *rest in read[kind]()]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, ValueError, struct.error, NotImplementedError, RuntimeError, IndexError):
        return [whole(False)]
    if not found:
        return [whole(False)]
    return [*found, whole(True)] if itself else found


def scan_files(spark: SparkSession, paths: list[str] | str, glob: str | None = None, literal: bool = False) -> DataFrame:
    """path, size, mtime, content of all files below paths. ``literal``: brackets and braces in paths mean themselves."""
    paths = [paths] if isinstance(paths, str) else paths
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load([escape_glob(p) if literal else p for p in paths])
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def scan_entries(files: DataFrame, quick: bool = False, bits: int = EVERY, itself: bool = False) -> DataFrame:
    """One row per file or archive entry of ``files`` (path, content), with the digests that ``bits`` asks for; others are null.

    quick: only what archives' directories tell. ``itself``: archives are also
    rows of their own bytes, without entry. Archives that are broken or that no
    reader is here for are only such a row, with supported false. Entries that
    are archives themselves are not opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.bool_()]
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, *x) for x in entries_of(path, body.as_py() or b"", quick, bits, itself)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, ENTRY)


def is_junk(path: Column) -> Column:
    """Whether a file's own name is one that systems leave behind."""
    return basename(path).rlike(JUNK)


def without_junk(entries: DataFrame) -> DataFrame:
    """Rows (path, entry) whose file and entry are worth keeping."""
    return entries.where(~is_junk(F.col("path")) & ~F.coalesce(is_junk(F.col("entry")), F.lit(False)))


def unique_files(files: DataFrame) -> DataFrame:
    """The first path of each content (path, file_hash), by a minimum that is aggregated before the shuffle."""
    return files.groupBy("file_hash").agg(F.min("path").alias("path")).select("path", "file_hash")


def folders_below(files: DataFrame, roots: list[str]) -> DataFrame:
    """dir: every folder below ``roots`` that has a file of ``files`` (path) in it or deeper."""
    below = F.array(*(F.lit(r.rstrip("/") + "/") for r in roots))
    rows = files.select("path", F.explode(F.filter(below, lambda r: F.startswith(F.col("path"), r))).alias("_root"))
    parts = F.slice(F.split(F.substring(F.col("path"), F.length("_root") + 1, F.length("path")), "/"), 1, F.size(F.split(F.substring(F.col("path"), F.length("_root") + 1, F.length("path")), "/")) - 1)
    deeper = rows.select("_root", parts.alias("_parts")).where(F.size("_parts") > 0).distinct()
    ups = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.concat("_root", F.array_join(F.slice("_parts", 1, i), "/")))
    return deeper.select(F.explode(ups).alias("dir")).distinct()


def emptied_folders(before: DataFrame, gone: DataFrame, roots: list[str], mode: str = "auto") -> DataFrame:
    """dir: folders below ``roots`` that have no file any more once ``gone`` (path) are moved.

    auto: only folders that a moved file was in, or above them; always: all;
    never: none.
    """
    folders = folders_below(before if mode == "always" else gone, roots)
    left = before.join(gone.select("path"), "path", "left_anti")
    found = folders.join(folders_below(left, roots), "dir", "left_anti")
    return found.where(F.lit(mode != "never"))


def scan_plain(files: DataFrame) -> DataFrame:
    """Files hashed as they are, by built-in functions."""
    size, *digests = content_hashes(F.col("content"))
    return files.select("path", size, *digests)


def exclude(paths: DataFrame, excluded: DataFrame) -> DataFrame:
    return paths.join(excluded.select("path").distinct(), "path", "left_anti")


def with_output_files(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs, and output files that are none, marked as not to be read from."""
    return inputs.withColumn("can_be_input", F.lit(True)).unionByName(exclude(outputs, inputs).withColumn("can_be_input", F.lit(False)))
