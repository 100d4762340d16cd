"""What a file's first bytes say: its type, its header, and its padding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _h(x: str) -> bytes:
    return bytes.fromhex(x)


# The logos that cartridges of two hand-held systems hold.
_LOGO_GB = _h("CEED6666CC0D000B03730083000C000D0008111F8889000EDCCC6EE6DDDDD999BBBB67636E0EECCCDDDC999FBBB9333E")
_LOGO_GBA = _h(
    "24FFAE51699AA2213D84820A84E409AD11248B98C0817F21A352BE199309CE2010464A4AF82731EC58C7E83382E3CEBF85F4DF94CE4B09C194568AC01372A7FC9F844D73A3CA9A615897A327FC039876231DC7610304AE56BF38840040A70EFDFF52FE036F9530F197FBC08560D68025A963BE03014E38E2F9A234FFBB3E0344780090CB88113A9465C07C6387F03CAFD625E48B380AAC7221D4F807"
)
# Extensions and the bytes at offsets that tell them (characters above 7F stand in UTF-8).
SIGNATURES: list[tuple[str, list[tuple[int, bytes]]]] = [
    (".elf", [(0, b"\x7fELF")]),
    (".7z", [(0, _h("377ABCAF271C"))]),
    (".bz2", [(0, b"BZh")]),
    (".gz", [(0, _h("1F8B08"))]),
    (".lz", [(0, b"LZIP")]),
    (".lz4", [(0, _h("04224D18"))]),
    (".lzh", [(0, b"-lh"), (4, b"-")]),
    (".oar", [(0, b"OAR")]),
    (".rar", [(0, b"Rar!\x1a\x07\x00")]),
    (".rar", [(0, b"Rar!\x1a\x07\x01\x00")]),
    (".rs", [(0, b"RSVKDATA")]),
    (".tar", [(257, b"ustar\x0000")]),
    (".tar", [(257, b"ustar  \x00")]),
    (".xar", [(0, b"xar!")]),
    (".xz", [(0, b"\xc3\xbd7zXZ\x00")]),
    (".z", [(0, _h("1F9D"))]),
    (".z", [(0, _h("1FA0"))]),
    (".zip", [(0, b"PK\x03\x04")]),
    (".zip", [(0, b"PK\x05\x06")]),
    (".zst", [(0, _h("28B52FFD"))]),
    (".z01", [(0, b"PK\x07\x08")]),
    (".chd", [(0, b"MComprHD")]),
    (".cso", [(0, b"CISO")]),
    (".dax", [(0, b"DAX")]),
    (".isz", [(0, b"IsZ!")]),
    (".zso", [(0, b"ZISO")]),
    (".a2r", [(0, b"A2R3\xc3\xbf\n\r\n")]),
    (".raw", [(0, b"\r\x04"), (4, b"host_date=")]),
    (".woz", [(0, b"WOZ2\xc3\xbf\n\r\n")]),
    (".a78", [(1, b"ATARI7800"), (0x64, b"ACTUAL CART DATA STARTS HERE")]),
    (".jag", [(0, b"JAGR")]),
    (".jag", [(0x1C, b"JAGR")]),
    (".j64", [(0, b"\xc3\xb6")]),
    (".bll", [(0, b"\xc2\x80\x08"), (6, b"BS93")]),
    (".bll", [(0, b"\xc2\x80\x08"), (6, b"LYNX")]),
    (".lnx", [(0, b"LYNX")]),
    (".crt", [(0, b"C64 CARTRIDGE ")]),
    (".crt", [(0, b"C128 CARTRIDGE ")]),
    (".crt", [(0, b"CBM2 CARTRIDGE ")]),
    (".crt", [(0, b"VIC20 CARTRIDGE ")]),
    (".crt", [(0, b"PLUS4 CARTRIDGE ")]),
    (".g64", [(0, b"GCR-1541")]),
    (".p00", [(0, b"C64File\x00")]),
    (".p64", [(0, b"P64-1541")]),
    (".t64", [(0, b"C64S tape image file".ljust(32, b"\x00"))]),
    (".tap", [(0, b"C64-TAPE-RAW")]),
    (".tap", [(0, b"C16-TAPE-RAW")]),
    (".x64", [(0, _h("43154164"))]),
    (".3ds", [(0x100, b"NCSD"), (0x200, b"\xff\xff\xff\xff")]),
    (".3dsx", [(0, b"3DSX")]),
    (".cia", [(0, _h("20200000")), (4, b"\x00\x00"), (6, b"\x00\x00")]),
    (".n64", [(0, _h("40123780"))]),
    (".v64", [(0, _h("37804012"))]),
    (".z64", [(0, _h("80371240"))]),
    (".ndd", [(0, _h("E848D31610"))]),
    (".fds", [(0, b"\x01*NINTENDO-HVC*")]),
    (".fds", [(0, b"FDS")]),
    (".bin", [(0, b"main.bs")]),
    (".gcz", [(0, _h("01C00BB1"))]),
    (".nkit.iso", [(0x200, b"NKIT")]),
    (".rvz", [(0, b"RVZ\x01")]),
    (".wia", [(0, b"WIA\x01")]),
    (".gb", [(0x104, _LOGO_GB), (0x143, b"\x00")]),
    (".gba", [(4, _LOGO_GBA)]),
    (".gbc", [(0x104, _LOGO_GB), (0x143, b"\x80")]),
    (".gbc", [(0x104, _LOGO_GB), (0x143, b"\xc0")]),
    (".nds", [(0xC0, _LOGO_GBA), (0x15C, _h("56CF"))]),
    (".dsi", [(0x12, b"\x03"), (0xC0, _LOGO_GBA), (0x15C, _h("56CF"))]),
    (".nes", [(0, b"NES\x1a")]),
    (".min", [(0x21A4, b"NINTENDO"), (0x21BC, b"2P" + bytes(18))]),
    (".smc", [(0, b"\x00\x01ME DOCTOR SF 3")]),
    (".smc", [(0, b"GAME DOCTOR SF 3")]),
    (".nca", [(0x200, b"NCA0")]),
    (".nca", [(0x200, b"NCA1")]),
    (".nca", [(0x200, b"NCA2")]),
    (".nca", [(0x200, b"NCA3")]),
    (".ncz", [(0x4000, b"NCZSECTN")]),
    (".nro", [(0x10, b"NRO0")]),
    (".nso", [(0, b"NSO0")]),
    (".nsp", [(0, b"PFS0")]),
    (".xci", [(0x100, b"HEAD"), (0x108, b"\xff\xff\xff\xff")]),
    (".zca", [(0, b"ZCA0")]),
    (".ccf", [(0, b"CCF\x00")]),
    (".vff", [(0, b"VFF ")]),
    (".wad", [(0, b"\x00\x00\x00\x20"), (4, b"ib"), (6, b"\x00\x00"), (12, b"\x00\x00\x00\x00")]),
    (".wad", [(0, b"\x00\x00\x00\x20"), (4, b"Is"), (6, b"\x00\x00"), (12, b"\x00\x00\x00\x00")]),
    (".wad", [(0, b"\x00\x00\x00\x70"), (4, b"Bk"), (6, b"\x00\x01"), (0x6E, b"\x00\x00")]),
    (".wdf", [(0, b"WII\x01DISC")]),
    (".wud", [(0, b"WUP-")]),
    (".wux", [(0, b"WUX0\x2e\xc3\x90\xc2\x99\x10")]),
    (".32x", [(0x100, b"SEGA 32X")]),
    (".gg", [(0x7FF0, b"TMR SEGA")]),
    (".md", [(0x100, b"SEGA            ")]),
    (".md", [(0x100, b"SEGA IS A REGISTERED")]),
    (".md", [(0x100, b"SEGA IS A TRADEMARK ")]),
    (".md", [(0x100, b"SEGA GENESIS")]),
    (".md", [(0x100, b" SEGA GENESIS")]),
    (".md", [(0x100, b"SEGA_GENESIS")]),
    (".md", [(0x100, b"SEGA MEGADRIVE")]),
    (".md", [(0x100, b"SEGA MEGA DRIVE")]),
    (".md", [(0x100, b" SEGA MEGA DRIVE")]),
    (".md", [(0x100, b"SEGA_MEGA_DRIVE")]),
    (".md", [(0x100, b" SEGA_MEGA_DRIVE")]),
    (".md", [(0x100, b"SEGASEGASEGA")]),
    (".smd", [(0x280, b"EAGNSS  ")]),
    (".smd", [(0x280, b"EAMG RV")]),
    (".smd", [(0x280, b"EAMG_RV")]),
    (".smd", [(0x280, b"EAMGDIE")]),
    (".smd", [(0x280, b"SG EEI  ")]),
    (".md", [(0x100, b"SEGA PICO")]),
    (".pbp", [(0, b"\x00PBP\x00\x00\x01\x00")]),
]
# Extensions of files that may have been trimmed.
TRIMMABLE = {".3ds", ".gba", ".nds", ".dsi"}
# Headers by name: offset and bytes, where data begins, extensions with and without it.
HEADERS: list[tuple[str, int, bytes, int, str, str]] = [
    ("No-Intro_A7800.xml", 1, _h("415441524937383030"), 128, ".a78", ".a78"),
    ("No-Intro_LNX.xml", 0, _h("4C594E58"), 64, ".lnx", ".lyx"),
    ("No-Intro_NES.xml", 0, _h("4E45531A"), 16, ".nes", ".nes"),
    ("No-Intro_FDS.xml", 0, _h("464453"), 16, ".fds", ".fds"),
    ("SMC", 3, bytes(509), 512, ".smc", ".sfc"),
    ("SMC_GAME_DOCTOR_1", 0, _h("00014D4520444F43544F522053462033"), 512, ".smc", ".sfc"),
    ("SMC_GAME_DOCTOR_2", 0, _h("47414D4520444F43544F522053462033"), 512, ".smc", ".sfc"),
]
FILL_BYTES = (0x00, 0xFF)
HEADER_TYPE = "struct<name:string,data_offset:int,headerless_ext:string>"


def _cartridge(content: bytes, skip: int) -> bool:
    """A 16-bit cartridge's own header at one of its three places: a known memory map, and a checksum with its complement."""
    for at in (skip + 0x7FB0, skip + 0xFFB0, skip + 0x40FFB0):
        head = content[at : at + 0x30]
        if len(head) >= 0x30 and head[0x25] & 0xE0 == 0x20 and head[0x25] & 0x0F in (0, 1, 2, 3, 5):
            complement, total = (int.from_bytes(head[i : i + 2], "little") for i in (0x2C, 0x2E))
            if total and complement ^ total == 0xFFFF:
                return True
    return False


#: More pieces first, then more bytes.
_ORDERED = sorted(SIGNATURES, key=lambda s: (-len(s[1]), -sum(len(v) for _, v in s[1])))


def detect(content: bytes) -> str | None:
    """The extension that a file's bytes tell, or None."""
    for ext, pieces in (x for x in _ORDERED if len(x[1]) > 1):
        if all(content[at : at + len(v)] == v for at, v in pieces):
            return ext
    if content[3:512] == bytes(509) and _cartridge(content, 512):
        return ".smc"
    for ext, pieces in (x for x in _ORDERED if len(x[1]) == 1):
        if all(content[at : at + len(v)] == v for at, v in pieces):
            return ext
    return ".sfc" if _cartridge(content, 0) else None


def header_of(content: Column) -> Column:
    """The first of HEADERS that the bytes have, as a struct, or null; ``substring`` reads only the head."""
    out = F.lit(None).cast(HEADER_TYPE)
    for name, at, magic, data, _, ext in reversed(HEADERS):
        found = F.struct(F.lit(name).alias("name"), F.lit(data).alias("data_offset"), F.lit(ext).alias("headerless_ext"))
        out = F.when(F.substring(content, at + 1, len(magic)) == F.lit(magic), found).otherwise(out)
    return out


def may_have_header(extension: Column, size: Column, glob_match: Column | None = None) -> Column:
    known = extension.isin(sorted({x[4] for x in HEADERS}))
    return (size > 0) & (known if glob_match is None else known | glob_match)


def with_headers(files: DataFrame) -> DataFrame:
    """``files`` (content) with header and the size and digests of what follows it; null without header."""
    rows = files.withColumn("header", header_of(F.col("content")))
    rest = F.when(F.col("header").isNotNull(), F.substring(F.col("content"), F.col("header.data_offset") + 1, F.octet_length("content")))
    return rows.select(
        "*", F.octet_length(rest).cast("long").alias("size_wo"), F.when(rest.isNotNull(), F.lower(F.lpad(F.hex(F.crc32(rest)), 8, "0"))).alias("crc32_wo"), F.md5(rest).alias("md5_wo"), F.sha1(rest).alias("sha1_wo"), F.sha2(rest, 256).alias("sha256_wo")
    )


def may_be_trimmed(size: Column) -> Column:
    """Not a power of two, in 64 bits."""
    return (size > 0) & (size.bitwiseAND(size - 1) != 0)


PADDING_TYPE = "array<struct<padded_size:bigint,fill_byte:int,crc32:string,md5:string,sha1:string,sha256:string>>"


def _paddings(content: bytes) -> list[dict]:
    size = 1 << (len(content) - 1).bit_length() if content else 0
    if size == len(content):
        return []
    out = []
    for fill in FILL_BYTES:
        rest, crc, sums = size - len(content), zlib.crc32(content), [hashlib.md5(content), hashlib.sha1(content), hashlib.sha256(content)]
        while rest:
            part = bytes([fill]) * min(rest, 1 << 20)
            crc, rest = zlib.crc32(part, crc), rest - len(part)
            for s in sums:
                s.update(part)
        out.append({"padded_size": size, "fill_byte": fill, "crc32": f"{crc:08x}", "md5": sums[0].hexdigest(), "sha1": sums[1].hexdigest(), "sha256": sums[2].hexdigest()})
    return out


def with_signatures(files: DataFrame, paddings: bool = False) -> DataFrame:
    """``files`` (path, content) with signature, can_be_trimmed and, if asked for, paddings up to the next power of two."""
    kinds = pa.list_(pa.struct([("padded_size", pa.int64()), ("fill_byte", pa.int32()), *((x, pa.string()) for x in ("crc32", "md5", "sha1", "sha256"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            kind = [detect(b or b"") for b in bodies]
            trim = [k in TRIMMABLE for k in kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kind, pa.string()), pa.array(trim), pa.array([_paddings(b or b"") if paddings else [] for b in bodies], kinds)], names=["path", "signature", "can_be_trimmed", "paddings"])

    return files.select("path", "content").mapInArrow(run, f"path string, signature string, can_be_trimmed boolean, paddings {PADDING_TYPE}")
