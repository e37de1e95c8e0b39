"""The text of binary Word files: a compound file's sectors, and the piece table of its main stream."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE = 0xFFFFFFFC  # sector numbers from here on are marks


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes):
        if content[:8] != _MAGIC:
            raise ValueError("not a compound file")
        self.content = content
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        directory, self.cutoff, mini_fat = (struct.unpack_from("<I", content, at)[0] for at in (48, 56, 60))
        if not 7 <= shift <= 16 or not 4 <= mini_shift < shift:
            raise ValueError("wrong sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        blocks = list(struct.unpack_from("<109I", content, 76))
        after, more = struct.unpack_from("<II", content, 68)
        for _ in range(more):  # further lists of the table's own sectors
            if after >= _FREE:
                break
            numbers = struct.unpack(f"<{self.size // 4}I", self._sector(after))
            blocks += numbers[:-1]
            after = numbers[-1]
        fat = b"".join(self._sector(b) for b in blocks if b < _FREE)
        self.next = struct.unpack(f"<{len(fat) // 4}I", fat)
        entries = self._chain(directory)
        self.streams: dict[str, tuple[int, int]] = {}
        root = (_FREE, 0)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            begin, size = struct.unpack_from("<IQ", entries, at + 116)
            if kind == 5:
                root = begin, size
            elif kind == 2:
                self.streams[name] = begin, size & 0xFFFFFFFF
        self.mini = self._chain(root[0])[: root[1]] if root[0] < _FREE else b""
        table = self._chain(mini_fat) if mini_fat < _FREE else b""
        self.mini_next = struct.unpack(f"<{len(table) // 4}I", table)

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        found = self.content[at : at + self.size]
        if not found:
            raise ValueError("a sector beyond the file's end")
        return found.ljust(self.size, b"\0")

    def _chain(self, number: int) -> bytes:
        out = []
        while number < _FREE:
            if len(out) > len(self.next):
                raise ValueError("a chain of sectors without end")
            out.append(self._sector(number))
            number = self.next[number]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        begin, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(begin)[:size]
        out, number = [], begin
        while number < _FREE and len(out) <= len(self.mini_next):
            out.append(self.mini[number * self.mini_size : (number + 1) * self.mini_size])
            number = self.mini_next[number]
        return b"".join(out)[:size]


def text(content: bytes) -> str:
    """The main text of a Word 97-2003 file, in the order of its pieces."""
    file = Compound(content)
    main = file.stream("WordDocument")
    if struct.unpack_from("<H", main, 0)[0] != 0xA5EC:
        raise ValueError("not a Word 97 document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        raise ValueError("encrypted")
    table = file.stream("1Table" if flags & 0x200 else "0Table")
    length = struct.unpack_from("<I", main, 76)[0]
    at, size = struct.unpack_from("<II", main, 418)
    end = at + size
    while at < end and table[at] == 1:  # runs of properties come before the pieces
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= end or table[at] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    out = []
    for i in range(n):
        where = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        signs = max(0, min(places[i + 1], length) - places[i])
        if where & 0x40000000:  # one byte a sign
            begin = (where & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + signs].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * signs].decode("utf-16-le", "replace"))
    return "".join(out)


def paragraphs(content: bytes) -> Iterator[str]:
    """Paragraphs of the main text; codes of fields go and their results stay, cells of tables are paragraphs."""
    plain = text(content)
    while (shorter := re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15", lambda m: m[1] or "", plain)) != plain:
        plain = shorter
    for paragraph in re.split("[\r\x07\x0c]", plain.removesuffix("\r")):
        yield re.sub("[\x00-\x08\x0e-\x1f]", "", paragraph.replace("\x0b", "\n").replace("\x1e", "\u2011").replace("\x1f", "\u00AD"))
