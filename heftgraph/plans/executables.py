"""Small executables with stated sections, symbols and functions, for the tables of derived.py and for tests.

A plan is a file but for its symbols: pieces at their places (what lies between them is zero) and where
symbols go, so that a large file can be written by many tasks, a run of symbols each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: (name, size, stored in the file, body)
Section = tuple[str, int, bool, bytes]
Symbol = tuple[str, int, int]
#: (place in the file, bytes)
Piece = tuple[int, bytes]


@dataclass
class Plan:
    """pieces; where the sections' bodies, the symbols and their names start; bytes a symbol; how a run of them is written."""

    pieces: list[Piece]
    bodies: list[int]
    table: int
    names: int
    step: int
    written: Callable[[list[bytes], np.ndarray, np.ndarray, int], tuple[bytes, bytes]]

    def run(self, names: list[bytes], sections: np.ndarray, addresses: np.ndarray, before: int, bytes_before: int) -> list[Piece]:
        """The pieces of these symbols, which follow so many others with so many bytes of names()."""
        table, strings = self.written(names, sections, addresses, bytes_before)
        return [(self.table + self.step * before, table), (self.names + bytes_before, strings)]


@dataclass
class Lines:
    """A line table of count functions, whose names take name_bytes with an end each."""

    count: int
    name_bytes: int
    text: int
    head: int = 8 + 8 * 8

    @property
    def first(self) -> int:
        return self.head + self.name_bytes + -(self.head + self.name_bytes) % 8

    @property
    def size(self) -> int:
        return self.first + 4 * (2 * self.count + 1) + 8 * self.count

    def ends(self, total: int) -> list[Piece]:
        """The header, and the place after the last of total bytes."""
        head = self.head
        header = b"\xf1\xff\xff\xff\0\0\x01\x08" + struct.pack("<8Q", self.count, 0, self.text, head, head, head, head, self.first)
        return [(0, header), (self.first + 8 * self.count, struct.pack("<I", total))]

    def run(self, names: list[bytes], sizes: np.ndarray, before: int, bytes_before: int, size_before: int) -> list[Piece]:
        """The pieces of these functions, which follow so many others."""
        n, at = len(names), 4 * (2 * self.count + 1)
        rows, records = np.zeros((n, 2), "<u4"), np.zeros((n, 2), "<u4")
        rows[:, 0] = _fit(size_before + _places(sizes), 32)
        rows[:, 1] = _fit(at + 8 * (before + np.arange(n)), 32)
        records[:, 0] = rows[:, 0]
        records[:, 1] = _fit(bytes_before + _places(_lengths(names)), 31)
        return [(self.head + bytes_before, _joined(names)), (self.first + 8 * before, rows.tobytes()), (self.first + at + 8 * before, records.tobytes())]


def _places(lengths: np.ndarray) -> np.ndarray:
    """Where each starts, if they lie one after the other."""
    return np.cumsum(lengths, dtype=np.int64) - lengths


def _lengths(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, names), np.int64, len(names)) + 1


def _joined(names: list[bytes]) -> bytes:
    return b"\0".join([*names, b""])


def _fit(values: np.ndarray, bits: int) -> np.ndarray:
    if len(values) and (values.min() < 0 or values.max() >= 1 << bits):
        raise OverflowError(f"a place beyond {bits} bits")
    return values


def _whole(pieces: list[Piece]) -> bytes:
    out = bytearray(max((at + len(raw) for at, raw in pieces), default=0))
    for at, raw in pieces:
        out[at : at + len(raw)] = raw
    return bytes(out)


def _made(plan: Plan, symbols: list[Symbol]) -> bytes:
    names = [s[0].encode() for s in symbols]
    return _whole([*plan.pieces, *plan.run(names, *(np.array([s[k] for s in symbols], np.int64) for k in (1, 2)), 0, 0)])


def line_table(functions: list[tuple[str, int]], text: int) -> bytes:
    """A table of the newest kind: (name, bytes) of functions that lie one after the other."""
    names, sizes = [name.encode() for name, _ in functions], np.array([size for _, size in functions], np.int64)
    lines = Lines(len(names), int(_lengths(names).sum()), text)
    return _whole([*lines.ends(int(sizes.sum())), *lines.run(names, sizes, 0, 0, 0)])


def build_info(system: str, arch: str, package: str, module: str) -> bytes:
    listing = f"path\t{package}\nmod\t{module}\t(devel)\t\nbuild\tGOARCH={arch}\nbuild\tGOOS={system}\n".encode()
    version, listing = b"go1.24", b"0" * 16 + listing + b"1" * 16
    size, n = b"", len(listing)
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            break
    return (b"\xff Go buildinf:" + b"\x08\x02").ljust(32, b"\0") + bytes([len(version)]) + version + size + listing


def _strings(names: list[str], start: bytes = b"\0") -> tuple[bytes, list[int]]:
    out, places = bytearray(start), []  # grows in place
    for name in names:
        places.append(len(out))
        out += name.encode() + b"\0"
    return bytes(out), places


def stored(section: Section) -> int:
    """Bytes of a section in the file."""
    return max(section[1], len(section[3])) if section[2] else 0


def elf_plan(sections: list[Section], count: int, name_bytes: int, base: int = 0x1000) -> Plan:
    """count symbols, whose names take name_bytes with an end each; sections from number 1 on."""
    every = [("", 0, True, b""), *sections]
    extra = [".symtab", ".strtab"] if count else []
    names, at = _strings([s[0] for s in every] + extra + [".shstrtab"])
    end, rows, pieces, bodies = 64, [], [], []
    addresses, addr = [0], base
    for s in sections:
        addresses.append(addr)
        addr += s[1] + 64
    for k, s in enumerate(every):
        rows.append((at[k], 0 if not k else 1 if s[2] else 8, 0, addresses[k], end, s[1], 0, 0, 1, 0))
        bodies.append(end)
        if s[2] and s[3]:
            pieces.append((end, s[3]))
        end += stored(s)
    table, strings = end, end
    if count:
        size = 24 * (count + 1)  # the first stands for none
        rows.append((at[len(every)], 2, 0, 0, end, size, len(every) + 1, 0, 8, 24))
        strings = end + size
        rows.append((at[len(every) + 1], 3, 0, 0, strings, name_bytes + 1, 0, 0, 1, 0))
        end = strings + name_bytes + 1
    rows.append((at[-1], 3, 0, 0, end, len(names), 0, 0, 1, 0))
    pieces.append((end, names))
    end += len(names)
    header = b"\x7fELF\x02\x01\x01".ljust(16, b"\0") + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, base, 0, end, 0, 64, 0, 0, 64, len(rows), len(rows) - 1)
    pieces += [(0, header), (end, b"".join(struct.pack("<IIQQQQIIQQ", *r) for r in rows))]

    def written(run, section, value, before):
        out = np.zeros(len(run), [("name", "<u4"), ("info", "u1"), ("other", "u1"), ("sect", "<u2"), ("value", "<u8"), ("size", "<u8")])
        out["name"], out["info"], out["other"] = _fit(1 + before + _places(_lengths(run)), 32), 2, 0
        out["sect"], out["value"] = section, np.array(addresses, np.int64)[section] + value
        return out.tobytes(), _joined(run)

    return Plan(pieces, bodies, table + 24, strings + 1, 24, written)


def mach_plan(sections: list[Section], count: int, name_bytes: int, base: int = 0x100000000) -> Plan:
    """count symbols, whose names take name_bytes with an end each; names of sections are 'segment section'."""
    size = 72 + 80 * len(sections)
    end = start = 32 + size + 24
    rows, pieces, bodies, addresses, addr = b"", [], [], [], base
    for name, length, backed, raw in sections:
        segment, _, own = name.partition(" ")
        rows += struct.pack("<16s16sQQIIIIIIII", own.encode(), segment.encode(), addr, length, end if backed else 0, 0, 0, 0, 0, 0, 0, 0)
        bodies.append(end)
        if backed and raw:
            pieces.append((end, raw))
        end += stored((name, length, backed, raw))
        addresses.append(addr)
        addr += length + 64
    strings = end + 16 * count
    segment = struct.pack("<II16sQQQQIIII", 0x19, size, b"__ALL", base, addr - base, start, end - start, 7, 7, len(sections), 0) + rows
    link = struct.pack("<IIIIII", 0x2, 24, end, count, strings, name_bytes + 1)
    pieces += [(0, struct.pack("<IIIIIIII", 0xFEEDFACF, 0x0100000C, 0, 2, 2, size + 24, 0, 0) + segment + link), (strings, b"\0")]

    def written(run, section, value, before):
        out = np.zeros(len(run), [("name", "<u4"), ("type", "u1"), ("sect", "u1"), ("desc", "<u2"), ("value", "<u8")])
        out["name"], out["type"], out["sect"] = _fit(1 + before + _places(_lengths(run)), 32), 15, section + 1
        out["value"] = np.array(addresses, np.int64)[section] + value
        return out.tobytes(), _joined(run)

    return Plan(pieces, bodies, end, strings + 1, 16, written)


#: A PE file's symbol holds a name of so many bytes itself.
SHORT = 8


def pe_plan(sections: list[Section], count: int, name_bytes: int) -> Plan:
    """count symbols; name_bytes are those of names of over SHORT bytes, with an end each."""
    end = 0x40 + 4 + 20 + 112 + 40 * len(sections)
    rows, pieces, bodies, addr = b"", [], [], 0x1000
    for name, length, backed, raw in sections:
        held = stored((name, length, backed, raw))
        rows += struct.pack("<8sIIIIIIHHI", name.encode(), length, addr, held, end if backed else 0, 0, 0, 0, 0, 0)
        bodies.append(end)
        if backed and raw:
            pieces.append((end, raw))
        end += held
        addr += length + 0x1000
    strings = end + 36 * count  # each with an auxiliary record
    coff = struct.pack("<HHIIIHH", 0x8664, len(sections), 0, end, 2 * count, 112, 2)
    optional = struct.pack("<HBBIIIIIQ", 0x20B, 1, 0, 0, 0, 0, 0, 0, 0x140000000).ljust(112, b"\0")
    pieces += [(0, b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + coff + optional + rows), (strings, struct.pack("<I", name_bytes + 4))]

    def written(run, section, value, before):
        out = np.zeros(len(run), [("name", "S8"), ("value", "<u4"), ("sect", "<i2"), ("type", "<u2"), ("kind", "u1"), ("aux", "u1"), ("more", "V18")])
        long = [n for n in run if len(n) > SHORT]
        apart = np.zeros((len(long), 2), "<u4")
        apart[:, 1] = _fit(4 + before + _places(_lengths(long)), 32)
        spots = iter(apart.view("S8")[:, 0])
        out["name"] = [next(spots) if len(n) > SHORT else n for n in run]
        out["value"], out["sect"], out["type"], out["kind"], out["aux"] = _fit(value, 32), section + 1, 0x20, 2, 1
        return out.tobytes(), _joined(long)

    return Plan(pieces, bodies, end, strings + 4, 36, written)


def _name_bytes(symbols: list[Symbol], over: int = -1) -> int:
    return sum(len(n) + 1 for n in (s[0].encode() for s in symbols) if len(n) > over)


def elf(sections: list[Section], symbols: list[Symbol], base: int = 0x1000) -> bytes:
    """Sections from number 1 on; symbols are (name, section, address in it)."""
    return _made(elf_plan(sections, len(symbols), _name_bytes(symbols), base), symbols)


def mach(sections: list[Section], symbols: list[Symbol], base: int = 0x100000000) -> bytes:
    """Names are 'segment section'; symbols are (name, section from 0, address in it)."""
    return _made(mach_plan(sections, len(symbols), _name_bytes(symbols), base), symbols)


def pe(sections: list[Section], symbols: list[Symbol]) -> bytes:
    """Symbols are (name, section from 0, address in it)."""
    return _made(pe_plan(sections, len(symbols), _name_bytes(symbols, SHORT)), symbols)
