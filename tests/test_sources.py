import gzip
import hashlib
import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import patching as B
from tallyforge.operators import sinks as K
from tallyforge.operators.matching import content_hashes
from tallyforge.sources import archives as A
from tallyforge.sources import catalogs as C
from tallyforge.sources import signatures as S
from tallyforge.streaming import incremental as N

XML = """<?xml version="1.0"?>
<datafile><header><name>Cat</name><version>1</version></header>
<game name="Empty" isbios="yes"><description>d</description><rom name="e.rom" size="0" crc="00000000"/></game>
<game name="Clone" cloneof="Empty"><category>Demos</category><release name="Clone" region="eur"/><rom name="sub\\a.rom" size="4" crc="F817A89F" sha1="c7059bb19433cc3cabaa6236c83d56668a843dd2"/><rom name="b.rom" size="4" crc="0x96170874" status="baddump"/><disk name="d" sha1="7bbef45b3bc70855010e02460717643125c3beca"/></game>
</datafile>"""
NESTED = """clrmamepro (
  name "Cat"
)
game (
  name "G (USA)"
  description "a \\"quoted\\" one"
  rom ( name "g (1).rom" size 4 crc F817A89F md5 5BBF5A52328E7439AE6E719DFE712200 )
  rom ( name two.rom size 4 crc 96170874 )
)"""


def test_xml(spark, tmp_path):
    (tmp_path / "a.dat").write_text(XML)
    games = C.read_catalogs(spark, str(tmp_path / "a.dat"))
    rows = {r["name"]: r for r in games.collect()}
    assert rows["Empty"]["is_bios"] and rows["Clone"]["clone_of"] == "Empty" and rows["Clone"]["releases"][0]["region"] == "EUR"
    roms = {r["name"]: r for r in C.roms_of(games).collect()}
    assert roms["sub/a.rom"]["crc32"] == "f817a89f" and roms["b.rom"]["crc32"] == "96170874" and roms["d"]["kind"] == "disk" and roms["e.rom"]["size"] == 0
    assert C.xml_headers(spark, str(tmp_path / "a.dat")).first()["name"] == "Cat"


def test_software_list(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<softwarelists><softwarelist name="l"><software name="x"><description>X</description><part name="cart"><dataarea name="rom"><rom name="x.bin" size="0x10" crc="00000001"/></dataarea></part></software></softwarelist></softwarelists>')
    rom = C.roms_of(C.read_catalogs(spark, str(tmp_path / "s.xml"))).first()
    assert (rom["name"], rom["size"], rom["crc32"]) == ("x.bin", 16, "00000001")


def test_nested_text(spark, tmp_path):
    (tmp_path / "n.dat").write_text(NESTED)
    games = C.read_catalogs(spark, str(tmp_path / "n.dat"))
    row = games.first()
    assert row["name"] == "G (USA)" and row["description"] == 'a "quoted" one' and row["dat_name"] == "Cat"
    assert [(r["name"], r["size"], r["crc32"]) for r in row["roms"]] == [("g (1).rom", 4, "f817a89f"), ("two.rom", 4, "96170874")]


def test_tab_separated(spark, tmp_path):
    one = hashlib.sha256(b"one\n").hexdigest()
    (tmp_path / "t.txt").write_text(f"{one}\td/G (Track 1).bin\t{'0' * 40}\t{'1' * 32}\tf817a89f\t4\n\td/G (Track 2).bin\t\t\t96170874\t4\nx\t\t\t\t\t\nbad\tname\tzz\tzz\tzz\t1\n")
    rows = C.read_catalogs(spark, str(tmp_path / "t.txt")).collect()
    assert [(r["name"], [x["name"] for x in r["roms"]]) for r in rows] == [("d/G", ["G (Track 1).bin", "G (Track 2).bin"])]


def test_digests_of_known_files(spark):
    rows = spark.createDataFrame([(bytearray(b"one\n"),), (bytearray(b""),)], "content binary").select(*content_hashes(F.col("content"))).collect()
    assert (rows[0]["crc32"], rows[0]["md5"], rows[0]["sha1"]) == ("f817a89f", "5bbf5a52328e7439ae6e719dfe712200", "c7059bb19433cc3cabaa6236c83d56668a843dd2")
    assert (rows[1]["crc32"], rows[1]["size"]) == ("00000000", 0)


def _zip(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def _tar(mode, **entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives(spark, tmp_path):
    bodies = {"a.zip": _zip(one=b"one\n", two=b"two\n"), "b.tar": _tar("w", one=b"one\n"), "c.tar.gz": _tar("w:gz", two=b"two\n"), "d.gz": gzip.compress(b"one\n"), "e.rom": b"one\n", "f.bin": _zip(one=b"one\n"), "invalid.zip": b"notazip\n", "g.7z": bytes.fromhex("377ABCAF271C") + b"rest"}
    chd = bytearray(124)
    chd[:16] = b"MComprHD" + struct.pack(">II", 124, 5)
    chd[32:40], chd[48:56], chd[64:84], chd[84:104] = struct.pack(">Q", 4096), struct.pack(">Q", 0), b"\x01" * 20, b"\x02" * 20
    bodies["h.chd"] = bytes(chd)
    nkit = bytearray(0x220)
    nkit[0x200:0x204], nkit[0x208:0x20C], nkit[0x210:0x214] = b"NKIT", bytes.fromhex("deadbeef"), struct.pack(">I", 7)
    bodies["i.nkit.iso"] = bytes(nkit)
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = A.scan_entries(A.scan_files(spark, str(tmp_path))).collect()
    found = {(r["path"].rsplit("/", 1)[1], r["entry"]): r for r in rows}
    crc = f"{zlib.crc32(b'one' + bytes([10])):08x}"
    for key in (("a.zip", "one"), ("b.tar", "one"), ("d.gz", "d"), ("e.rom", None), ("f.bin", "one")):
        assert found[key]["crc32"] == crc and found[key]["sha1"] == "c7059bb19433cc3cabaa6236c83d56668a843dd2"
    assert ("c.tar.gz", "two") in found and not found["invalid.zip", None]["supported"]
    assert found["g.7z", None]["supported"] is False
    chds = sorted((r["size"], r["sha1"]) for r in rows if r["path"].endswith("h.chd"))
    assert chds == [(0, "02" * 20), (4096, "01" * 20)]
    assert (found["i.nkit.iso", "i.iso"]["crc32"], found["i.nkit.iso", "i.iso"]["size"]) == ("deadbeef", 7)
    quick = {r["entry"]: r for r in A.scan_entries(A.scan_files(spark, str(tmp_path), "a.zip"), quick=True).collect()}
    assert quick["one"]["crc32"] == crc and quick["one"]["sha1"] is None


def test_nothing_vanishes(spark, tmp_path):
    """Much packed entries have every digest, broken archives a row, and only wanted digests are made."""
    zeros = bytes(2 << 20)
    for name, how in (("lzma.zip", zipfile.ZIP_LZMA), ("bz.zip", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(tmp_path / name, "w", how) as z:
            z.writestr("zeros.bin", zeros)
            z.writestr("__MACOSX", b"x")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 not a zip")
    (tmp_path / "late.bin").write_bytes(bytes(90_000) + b"tail")
    files = A.scan_files(spark, str(tmp_path))
    rows = {(r["path"].rsplit("/", 1)[-1], r["entry"]): r for r in A.without_junk(A.scan_entries(files)).collect()}
    assert set(rows) == {("lzma.zip", "zeros.bin"), ("bz.zip", "zeros.bin"), ("broken.zip", None), ("late.bin", None)}
    assert {rows[k]["sha1"] for k in rows if k[1]} == {hashlib.sha1(zeros).hexdigest()}
    assert not rows["broken.zip", None]["supported"] and rows["broken.zip", None]["sha1"]
    few = {(r["path"].rsplit("/", 1)[-1], r["entry"]): r for r in A.scan_entries(files, bits=0x101, itself=True).collect()}
    assert few["bz.zip", None]["sha1"] and few["bz.zip", "zeros.bin"]["crc32"] and not any(r["md5"] or r["sha256"] for r in few.values())
    only = {r["entry"]: r for r in A.scan_entries(files.where("path like '%lzma.zip'"), bits=1).collect()}
    assert only["zeros.bin"]["crc32"] == f"{zlib.crc32(zeros):08x}" and only["zeros.bin"]["sha1"] is None


def test_emptied_folders(spark):
    files = spark.createDataFrame([("in/a/b/1",), ("in/a/2",), ("in/c/d/3",), ("out/4",)], "path string")
    gone = files.where("path in ('in/a/b/1', 'in/c/d/3')")
    names = lambda df: sorted(r["dir"] for r in df.collect())
    assert names(A.folders_below(files, ["in"])) == ["in/a", "in/a/b", "in/c", "in/c/d"]
    assert names(A.emptied_folders(files, gone, ["in/"])) == ["in/a/b", "in/c", "in/c/d"]
    assert names(A.emptied_folders(files, gone, ["in"], "never")) == []


def test_headers_signatures_and_padding(spark):
    body = b"NES\x1a" + bytes(12) + b"data"
    row = S.with_headers(spark.createDataFrame([("a.nes", bytearray(body)), ("b", bytearray(b"one\n"))], "path string, content binary")).orderBy("path").collect()
    assert row[0]["header"]["name"] == "No-Intro_NES.xml" and row[0]["md5_wo"] == hashlib.md5(b"data").hexdigest() and row[0]["size_wo"] == 4
    assert row[1]["header"] is None and row[1]["md5_wo"] is None
    assert S.detect(body) == ".nes" and S.detect(b"PK\x03\x04x") == ".zip" and S.detect(b"one\n") is None
    rom = bytearray(0x8000)
    rom[0x7FB0 + 0x25], rom[0x7FB0 + 0x2C : 0x7FB0 + 0x30] = 0x20, struct.pack("<HH", 0xFFFF ^ 0x1234, 0x1234)
    assert S.detect(bytes(rom)) == ".sfc"
    pads = S.with_signatures(spark.createDataFrame([("p", bytearray(b"abcde"))], "path string, content binary"), paddings=True).first()["paddings"]
    assert [(p["padded_size"], p["fill_byte"], p["md5"]) for p in pads] == [(8, 0, hashlib.md5(b"abcde\0\0\0").hexdigest()), (8, 255, hashlib.md5(b"abcde\xff\xff\xff").hexdigest())]


def _beat(n):
    out = bytearray()
    while True:
        x, n = n & 0x7F, n >> 7
        if not n:
            return bytes(out + bytes([x | 0x80]))
        out.append(x)
        n -= 1


def _sealed(body, source, target):
    body += struct.pack("<II", zlib.crc32(source), zlib.crc32(target))
    return body + struct.pack("<I", zlib.crc32(body))


BEFORE, AFTER = b"before\n", b"AFTER\n"


def _patches():
    bps = _sealed(b"BPS1" + _beat(7) + _beat(6) + _beat(0) + _beat((4 << 2) | 1) + b"AFTER" + _beat((0 << 2) | 2) + _beat(6 << 1), BEFORE, AFTER)
    xor = bytes(a ^ b for a, b in zip(BEFORE, AFTER.ljust(7, b"\0"), strict=True))
    ups = _sealed(b"UPS1" + _beat(7) + _beat(6) + _beat(0) + xor[:6].split(b"\0")[0] + b"\0", BEFORE, AFTER)
    yield "bps", bps, AFTER
    yield "ups", ups, AFTER
    yield "ups", _sealed(b"UPS1" + _beat(7) + _beat(7) + _beat(2) + bytes([ord("f") ^ ord("X")]) + b"\0" + _beat(1) + bytes([ord("e") ^ ord("Y")]) + b"\0", BEFORE, b"beXorY\n"), b"beXorY\n"
    yield "ips", b"PATCH" + b"\0\0\x01\0\x01Q" + b"EOF" + b'{"title": "t"}', b"bQfore\n"
    yield "ppf", b"PPF20\x01" + bytes(50) + struct.pack("<I", 7) + bytes(1024) + struct.pack("<IB", 2, 2) + b"YY", b"beYYre\n"
    yield "ips", b"PATCH" + b"\0\0\0\0\x02AB" + b"\0\0\x04\0\0\0\x02z" + b"EOF" + b"\0\0\x06", b"ABfozz"
    yield "ips", b"IPS32" + b"\0\0\0\x01\0\x01X" + b"EEOF", b"bXfore\n"
    yield "ppf", b"PPF30\x02" + bytes(50) + bytes(4) + struct.pack("<QB", 2, 2) + b"YY", b"beYYre\n"
    yield "aps", b"APS10\0\0" + bytes(50) + struct.pack("<I", 6) + struct.pack("<IB", 0, 2) + b"QQ" + struct.pack("<IBBB", 3, 0, 87, 2), b"QQfWWe"
    yield "aps", b"APS1" + struct.pack("<III", 7, 7, 0) + b"\0\0\0\0" + bytes([1]) + bytes(0xFFFF), b"cefore\n"
    yield "dps", bytes(194) + struct.pack("<I", 7) + b"\x01" + struct.pack("<II", 0, 1) + b"B" + b"\0" + struct.pack("<III", 7, 0, 3), b"Before\nbef"
    yield "ninja", b"NINJA2".ljust(2048, b"\0") + b"\x01\x00\x00\x01\x07\x01\x07" + hashlib.md5(BEFORE).digest() + bytes(16) + b"\x02\x01\x00\x01\x01\x20" + b"\x00", b"Before\n"
    yield "vcdiff", b"\xd6\xc3\xc4\0\0" + b"\x01\x07\x00" + bytes([12 + 2, 9, 0, 3, 3, 2]) + b"abc" + bytes([4, 22 - 0, 21]) + b"\0\0", None


@pytest.mark.parametrize(("kind", "patch", "want"), [p for p in _patches() if p[2]])
def test_patches(kind, patch, want):
    assert B.apply_patch(BEFORE, patch, kind) == want


def test_vcdiff():
    # add "ab", copy 4 from address 0 of the source, run of two "z"
    data, codes, addresses = b"abz", bytes([3, 20, 0, 2]), b"\0"
    body = b"\x08" + b"\0" + bytes([len(data), len(codes), len(addresses)]) + data + codes + addresses
    patch = b"\xd6\xc3\xc4\0\0" + b"\x01\x07\x00" + bytes([len(body)]) + body
    assert B.apply_patch(BEFORE, patch, "vcdiff") == b"abbefozz"


def test_patch_scan_and_errors(spark):
    bps = next(p for k, p, _ in _patches() if k == "bps")
    files = spark.createDataFrame([("x.bps", bytearray(bps)), ("d/fix 0361b321.ips", bytearray(b"PATCHEOF")), ("no.txt", bytearray(b"t"))], "path string, content binary")
    rows = {r["path"]: r for r in B.scan_patches(files).collect()}
    assert set(rows) == {"x.bps", "d/fix 0361b321.ips"}
    assert rows["x.bps"]["crc_before"] == "0361b321" and rows["x.bps"]["size_after"] == 6 and rows["d/fix 0361b321.ips"]["rom_name"] == "fix"
    pairs = spark.createDataFrame([(1, bytearray(BEFORE), bytearray(bps), "bps"), (2, bytearray(b"no"), bytearray(bps), "bps")], "id int, source binary, patch binary, format string")
    made = {r["id"]: r for r in B.apply_patches(pairs).collect()}
    assert bytes(made[1]["content"]) == AFTER and made[2]["content"] is None and made[2]["error"]


def test_torrentzip_and_plan(tmp_path):
    body = K.torrentzip([("b", b"2"), ("A", b"1")])
    assert K.is_torrentzip(body) and not K.is_torrentzip(_zip(a=b"1"))
    (tmp_path / "in").write_bytes(b"one\n")
    row = {"path": str(tmp_path / "in"), "out_path": str(tmp_path / "o/x"), "action": "write", "sha1": "c7059bb19433cc3cabaa6236c83d56668a843dd2"}
    assert K.carry_out([row])[0]["error"] is None and (tmp_path / "o/x").read_bytes() == b"one\n"
    assert K.carry_out([{**row, "action": "test"}])[0]["done"] == "skip"
    assert K.carry_out([{**row, "sha1": "0" * 40}], retries=0)[0]["error"] == "checksum"
    K.carry_out([row], "move")
    assert not (tmp_path / "in").exists()
    assert K.clean([str(tmp_path / "o/x")], root=str(tmp_path)) and not (tmp_path / "o").exists()


def test_catalog_text(spark):
    games = spark.createDataFrame([("D", 0, "A & B", None, None, [("a.rom", 1, "00000001")]), ("D", 1, "C", "gone", None, [])], "dat_name string, game_ord int, name string, clone_of string, description string, roms array<struct<name:string,size:bigint,crc32:string>>")
    row = K.catalog_texts(games).first()
    assert row["file_name"] == "D.dat" and '<game name="A &amp; B">' in row["body"] and 'crc="00000001"' in row["body"] and "cloneof" not in row["body"]


def test_rescan_reads_only_what_is_new(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\n")
    first = N.rescan(A.scan_files(spark, str(tmp_path)), None)
    snapshot = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "b").write_bytes(b"two\n")
    files = A.scan_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in N.unseen(files, snapshot).collect()] == ["b"]
    assert N.rescan(files, snapshot).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"one\n")
    for _ in range(2):
        N.follow(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
