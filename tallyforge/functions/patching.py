"""Binary patches: parsing what they fit and applying them to bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PatchError(ValueError):
    """The patch is damaged or does not fit."""


class Reader:
    """Reads numbers and bytes in order."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise PatchError("the patch ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, order: str = "little") -> int:
        return int.from_bytes(self.take(n), order)

    def beat(self) -> int:
        """A number of 7-bit parts, the least first, in which each further part counts one more; the last has its top bit set."""
        out, step = 0, 1
        while True:
            x = self.take(1)[0]
            out += (x & 0x7F) * step
            if x & 0x80:
                return out
            step <<= 7
            out += step

    def big7(self) -> int:
        """A number of 7-bit parts, the most first; all but the last have their top bit set."""
        out = 0
        while True:
            x = self.take(1)[0]
            out = out << 7 | x & 0x7F
            if not x & 0x80:
                return out

    def counted(self) -> int:
        """A byte that tells how many follow, and those, the least first."""
        return self.number(self.take(1)[0])

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def _put(out: bytearray, at: int, data: bytes) -> None:
    if at > len(out):
        out.extend(bytes(at - len(out)))
    out[at : at + len(data)] = data


def _ips(source: bytes, patch: bytes) -> bytes:
    wide = patch[:5] == b"IPS32"
    if not wide and patch[:5] != b"PATCH":
        raise PatchError("not an IPS patch")
    n, end, r, out = (4, b"EEOF", Reader(patch, 5), bytearray(source)) if wide else (3, b"EOF", Reader(patch, 5), bytearray(source))
    while r.left:
        head = r.take(n)
        if head == end[:n] and (r.left in (0, n) or patch[r.at : r.at + 1] == b"{" or r.left < 3):
            if r.left == n:
                del out[r.number(n, "big") :]
            break
        size = r.number(2, "big")
        data = r.take(size) if size else None
        if data is None:
            count = r.number(2, "big")
            data = r.take(1) * count
        _put(out, int.from_bytes(head, "big"), data)
    return bytes(out)


def _checked(name: str, source: bytes, patch: bytes) -> Reader:
    if patch[:4] != name or len(patch) < 16:
        raise PatchError(f"not a {name!r} patch")
    if zlib.crc32(patch[:-4]) != int.from_bytes(patch[-4:], "little"):
        raise PatchError("the patch's own CRC is wrong")
    return Reader(patch[:-12], 4)


def _bps(source: bytes, patch: bytes) -> bytes:
    r = _checked(b"BPS1", source, patch)
    source_size, size = r.beat(), r.beat()
    r.take(r.beat())
    if source_size != len(source):
        raise PatchError("the source's size differs")
    out, source_at, target_at = bytearray(), 0, 0
    while r.left:
        x = r.beat()
        kind, n = x & 3, (x >> 2) + 1
        if kind == 0:
            out += source[len(out) : len(out) + n]
        elif kind == 1:
            out += r.take(n)
        else:
            step = r.beat()
            step = -(step >> 1) if step & 1 else step >> 1
            if kind == 2:
                source_at += step
                out += source[source_at : source_at + n]
                source_at += n
            else:
                target_at += step
                while n:  # what is copied may be what this copy writes
                    part = out[target_at : target_at + n]
                    if not part:
                        raise PatchError("a copy from behind the end")
                    out += part
                    target_at, n = target_at + len(part), n - len(part)
    if len(out) != size:
        raise PatchError("the result's size differs")
    return bytes(out)


def _ups(source: bytes, patch: bytes) -> bytes:
    r = _checked(b"UPS1", source, patch)
    first, second = r.beat(), r.beat()
    size = second if len(source) == first else first
    out, at = bytearray(source[:size].ljust(size, b"\0")), 0
    while r.left:
        at += r.beat()
        stop = r.data.find(b"\0", r.at)
        stop = len(r.data) if stop < 0 else stop
        for x in r.take(stop - r.at):
            if at < size:
                out[at] ^= x
            at += 1
        if r.left:
            r.take(1)
        at += 1
    return bytes(out)


def _ppf(source: bytes, patch: bytes) -> bytes:
    version = patch[:5]
    if version not in (b"PPF20", b"PPF30"):
        raise PatchError("not a PPF patch of version 2 or 3")
    r, out, undo, n = Reader(patch, 56), bytearray(source), False, 4
    if version == b"PPF20":
        r.take(4 + 1024)
    else:
        n, (_, check, undo, _) = 8, r.take(4)
        r.take(1024 if check else 0)
    while r.left and not r.data.startswith(b"@BEGIN_FILE_ID.DIZ", r.at):
        at = r.number(n)
        size = r.take(1)[0]
        _put(out, at, r.take(size))
        if undo:
            r.take(size)
    return bytes(out)


def _aps_gba(source: bytes, patch: bytes) -> bytes:
    r = Reader(patch, 4)
    source_size, size = r.number(4), r.number(4)
    if source_size != len(source):
        raise PatchError("the source's size differs")
    out = bytearray(source[:size].ljust(size, b"\0"))
    while r.left:
        at, _, _ = r.number(4), r.number(2), r.number(2)
        block = r.take(min(0x10000, r.left))
        part = out[at : at + len(block)]
        out[at : at + len(part)] = (int.from_bytes(part, "big") ^ int.from_bytes(block[: len(part)], "big")).to_bytes(len(part), "big")
    return bytes(out)


def _aps_n64(source: bytes, patch: bytes) -> bytes:
    kind, r = patch[5], Reader(patch, 57)
    if kind == 1:
        r.take(17)
    size = r.number(4)
    out = bytearray(source[:size].ljust(size, b"\0"))
    while r.left:
        at, n = r.number(4), r.take(1)[0]
        if n:
            _put(out, at, r.take(n))
        else:
            value = r.take(1)
            _put(out, at, value * r.take(1)[0])
    return bytes(out[:size])


def _aps(source: bytes, patch: bytes) -> bytes:
    return _aps_n64(source, patch) if patch[:5] == b"APS10" else _aps_gba(source, patch)


def _dps(source: bytes, patch: bytes) -> bytes:
    r, out = Reader(patch, 194), bytearray(source)
    if r.number(4) != len(source):
        raise PatchError("the source's size differs")
    while r.left:
        kind, at = r.take(1)[0], r.number(4)
        if kind == 0:
            start, n = r.number(4), r.number(4)
            _put(out, at, source[start : start + n])
        else:
            _put(out, at, r.take(r.number(4)))
    return bytes(out)


def _ninja(source: bytes, patch: bytes) -> bytes:
    if patch[:6] != b"NINJA2":
        raise PatchError("not a NINJA 2 patch")
    r, out = Reader(patch, 2048), bytearray(source)
    while r.left:
        command = r.take(1)[0]
        if command == 0:
            break
        if command == 1:
            if r.counted():
                raise PatchError("patches of several files cannot be applied")
            if r.take(1)[0]:
                raise PatchError("only raw files can be patched")
            first, second = r.counted(), r.counted()
            before, after = r.take(16), r.take(16)
            own = hashlib.md5(source).digest()
            if own not in (before, after):
                raise PatchError("the source's MD5 differs")
            size = second if own == before else first
            if first != second:
                overflow = r.take(1)
                extra = bytes(x ^ 0xFF for x in r.take(r.counted()))
                if (overflow == b"A") == (own == before):
                    out += extra
            del out[size:]
        else:
            at, data = r.counted(), r.take(r.counted())
            _put(out, len(out), bytes(max(0, at + len(data) - len(out))))
            for i, x in enumerate(data, at):
                out[i] ^= x
    return bytes(out)


def _code_table() -> list[tuple[tuple[str, int, int], tuple[str, int, int]]]:
    """The default instructions of VCDIFF: two (kind, size, mode) per code."""
    none = ("", 0, 0)
    out = [(("run", 0, 0), none), *((("add", n, 0), none) for n in range(18))]
    for mode in range(9):
        out += [(("copy", 0, mode), none), *((("copy", n, mode), none) for n in range(4, 19))]
    for mode in range(6):
        out += [(("add", a, 0), ("copy", c, mode)) for a in range(1, 5) for c in range(4, 7)]
    for mode in range(6, 9):
        out += [(("add", a, 0), ("copy", 4, mode)) for a in range(1, 5)]
    return out + [(("copy", 4, mode), ("add", 1, 0)) for mode in range(9)]


_CODES = _code_table()


def _vcdiff(source: bytes, patch: bytes) -> bytes:
    r = Reader(patch)
    if r.take(3) != b"\xd6\xc3\xc4":
        raise PatchError("not a VCDIFF patch")
    r.take(1)
    flags = r.take(1)[0]
    if flags & 1:
        raise PatchError("secondary compression cannot be read")
    if flags & 2:
        raise PatchError("own code tables cannot be read")
    if flags & 4:
        r.take(r.big7())
    out = bytearray()
    while r.left:
        window = r.take(1)[0]
        segment = b""
        if window & 3:
            n, at = r.big7(), r.big7()
            segment = (source if window & 1 else bytes(out))[at : at + n]
        r.big7()
        size = r.big7()
        if r.take(1)[0]:
            raise PatchError("compressed sections cannot be read")
        lengths = r.big7(), r.big7(), r.big7()
        if window & 4:
            r.take(4)
        data, codes, addresses = (Reader(r.take(n)) for n in lengths)
        made, near, next_near, same = bytearray(), [0] * 4, 0, [0] * 768
        while codes.left:
            for kind, n, mode in _CODES[codes.take(1)[0]]:
                if not kind:
                    continue
                n = n or codes.big7()
                if kind == "run":
                    made += data.take(1) * n
                elif kind == "add":
                    made += data.take(n)
                else:
                    here = len(segment) + len(made)
                    at = addresses.big7() if mode == 0 else here - addresses.big7() if mode == 1 else near[mode - 2] + addresses.big7() if mode < 6 else same[(mode - 6) * 256 + addresses.take(1)[0]]
                    near[next_near], same[at % 768] = at, at
                    next_near = (next_near + 1) % 4
                    for _ in range(n) if at + n > here else ():
                        made.append(segment[at] if at < len(segment) else made[at - len(segment)])
                        at += 1
                    if at + n <= here:
                        first = segment[at : at + n]
                        made += first
                        rest = at + len(first) - len(segment)
                        made += made[rest : rest + n - len(first)]
        if len(made) != size:
            raise PatchError("a window's size differs")
        out += made
    return bytes(out)


#: Formats by name: extensions, first bytes, how they are applied.
FORMATS: dict[str, tuple[tuple[str, ...], tuple[bytes, ...], Callable[[bytes, bytes], bytes]]] = {
    "ips": ((".ips", ".ips32", ".ebp"), (b"PATCH", b"IPS32"), _ips),
    "bps": ((".bps",), (b"BPS1",), _bps),
    "ups": ((".ups",), (b"UPS1",), _ups),
    "ppf": ((".ppf",), (b"PPF20", b"PPF30"), _ppf),
    "vcdiff": ((".vcdiff", ".xdelta"), (b"\xd6\xc3\xc4",), _vcdiff),
    "aps": ((".aps",), (b"APS1",), _aps),
    "dps": ((".dps",), (), _dps),
    "ninja": ((".rup",), (b"NINJA2",), _ninja),
}


def format_of(path: str, content: bytes) -> str | None:
    """By extension first, then by the first bytes."""
    for name, (extensions, _, _) in FORMATS.items():
        if path.lower().endswith(extensions):
            return name
    return next((name for name, (_, magic, _) in FORMATS.items() if magic and content.startswith(magic)), None)


def apply_patch(source: bytes, patch: bytes, kind: str) -> bytes:
    return FORMATS[kind][2](source, patch)


def facts(path: str, content: bytes) -> tuple[str | None, str | None, str | None, int | None]:
    """(format, crc_before, crc_after, size_after) as far as the patch itself tells them."""
    kind = format_of(path, content)
    try:
        if kind in ("bps", "ups"):
            r = Reader(content, 4)
            r.beat()
            before, after, own = struct.unpack("<III", content[-12:])
            if zlib.crc32(content[:-4]) != own:
                return kind, None, None, None
            return kind, f"{before:08x}", f"{after:08x}", r.beat()
        if kind == "aps" and content[:5] != b"APS10":
            return kind, None, None, int.from_bytes(content[8:12], "little")
    except (PatchError, struct.error):
        pass
    return kind, None, None, None


def scan_patches(files: DataFrame) -> DataFrame:
    """path, format, crc_before, crc_after, size_after, rom_name of the patches among ``files`` (path, content); a CRC that the patch does not hold comes from its name."""
    from tallyforge.functions.text import crc_in_name, patched_name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(p, c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[i], pa.string()) for i in range(3)), pa.array(columns[3], pa.int64())], names=["path", "format", "crc_before", "crc_after", "size_after"])

    found = files.select("path", "content").mapInArrow(run, "path string, format string, crc_before string, crc_after string, size_after long").where("format is not null")
    return found.withColumn("crc_before", F.coalesce("crc_before", crc_in_name(F.col("path")))).where("crc_before is not null").withColumn("rom_name", patched_name(F.col("path")))


def apply_patches(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id, source, patch, format) as id, content and error; a patch that does not fit gives an error, not a failure."""
    kind = dict(pairs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for source, patch, form in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                try:
                    made.append(apply_patch(source, patch, form))
                    errors.append(None)
                except (PatchError, KeyError, IndexError, TypeError) as e:
                    made.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["id", "content", "error"])

    return pairs.select("id", "source", "patch", "format").mapInArrow(run, f"id {kind}, content binary, error string")
