"""ZIP archives with stored members, written and read by ranges; no Spark. Layouts follow the public APPNOTE and WARC 1.1."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

#: Fixed values of the ZIP format: signatures, sizes of fixed parts, and marks for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
WIDE, SHORT = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # where its local header starts


class Writer:
    """Stored members, one after another, to a stream that need not seek. zip64: always write the ZIP64 fields."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, *parts: bytes) -> int:
        """Writes a member, the parts one after another; returns where its data starts."""
        raw, header = name.encode(), self.at
        length, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        wide = self.zip64 or length >= WIDE
        extra = struct.pack("<HHQQ", 1, 16, length, length) if wide else b""
        size = WIDE if wide else length
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        start = self.at
        for part in parts:
            self._put(part)
        self.members.append(Member(name, 0, crc, length, length, header))
        return start

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            wide = self.zip64 or m.size >= WIDE or m.header >= WIDE
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header) if wide else b""
            size, at = (WIDE, WIDE) if wide else (m.size, m.header)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        length, count = self.at - start, len(self.members)
        wide = self.zip64 or count >= SHORT or length >= WIDE or start >= WIDE
        if wide:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            count, length, start = SHORT, WIDE, WIDE
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, length, start, 0))


def _range(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the archive ends early")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """The central directory: found from the archive's end, through the ZIP64 locator where there is one."""
    tail_at = max(0, size - 22 - SHORT)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
    if SHORT in (count,) or WIDE in (length, start):
        signature, _, at, _ = struct.unpack("<IIQI", _range(file, tail_at + end - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        fields = struct.unpack("<IQHHIIQQQQ", _range(file, at, 56))
        if fields[0] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = fields[7:10]
    raw, at, out = _range(file, start, length), 0, []
    for _ in range(count):
        f = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if f[0] != CENTRAL:
            raise ValueError("no central directory header")
        n, e, c = f[10:13]
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + e]
        packed, whole, header = f[8], f[9], f[16]
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                whole = next(values) if whole == WIDE else whole
                packed = next(values) if packed == WIDE else packed
                header = next(values) if header == WIDE else header
            extra = extra[4 + long :]
        out.append(Member(name, f[4], f[7], packed, whole, header))
        at += 46 + n + e + c
    return out


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes start. Packed members are refused: their ranges are not their content."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    f = struct.unpack("<IHHHHHIIIHH", _range(file, member.header, 30))
    if f[0] != LOCAL:
        raise ValueError("no local header")
    return member.header + 30 + f[9] + f[10]
