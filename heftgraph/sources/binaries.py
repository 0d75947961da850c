"""Executables: sections, symbols and function tables of ELF, Mach-O and PE files.

A file is parsed by one task, in parts: from its row, which Spark reads whole, or, if it comes in pieces,
from a scratch file of that task. Symbols and functions leave in rows of RUN, read with numpy, so that the
memory of a task doesn't grow with the file. Addresses of symbols are relative to their section. What a
file doesn't have is empty; a file of another format raises.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.operators.storage import bounded

# Fixed values of the formats.
BUILD_MAGIC = b"\xff Go buildinf:"
TABLE_MAGICS = (b"\xfb\xff\xff\xff", b"\xfa\xff\xff\xff", b"\xf0\xff\xff\xff", b"\xf1\xff\xff\xff")
#: A file with fewer symbols counts as stripped.
LEAST_SYMBOLS = 500

#: Symbols or functions of a row; Spark reads some thousand rows of a column at once.
RUN = 64
#: Symbols or functions of a step, bytes that are read at once, and gaps that are read over.
STEP, BLOCK, GAP = 1 << 14, 8 << 20, 1 << 12

#: A file has a row for each RUN of symbols or functions; part 0 has the sections.
FILE = (
    "path string, part int, format string, file_size long, system string, arch string, main_package string, main_module string, stripped boolean, "
    "sections array<struct<sect: int, name: string, addr: long, size: long, file_backed: boolean, is_text: boolean, is_pclntab: boolean>>, "
    "symbols array<struct<sect: int, addr: long, name: string>>, functions array<struct<name: string, size: long>>"
)


class View:
    """A part of a file, whose bytes are held or read from a descriptor where they are asked for."""

    def __init__(self, held: bytes | int, at: int, size: int):
        self.held, self.at, self.size = held, at, size

    @classmethod
    def of(cls, raw: bytes | View) -> View:
        return raw if isinstance(raw, View) else cls(raw, 0, len(raw))

    def __len__(self) -> int:
        return self.size

    def sub(self, at: int, size: int | None = None) -> View:
        at = min(max(at, 0), self.size)
        return View(self.held, self.at + at, self.size - at if size is None else min(size, self.size - at))

    def read(self, at: int, size: int) -> bytes:
        """So many bytes, fewer at the end."""
        if not 0 <= at < self.size:
            return b""
        at, size = self.at + at, min(size, self.size - at)
        if not isinstance(self.held, int):
            return self.held[at : at + size]
        parts = []
        while size > 0 and (part := os.pread(self.held, size, at)):
            parts.append(part)
            at, size = at + len(part), size - len(part)
        return b"".join(parts)

    def byte(self, at: int) -> int:
        return self.read(at, 1)[0]

    def unpack(self, kind: str, at: int) -> tuple:
        return struct.unpack(kind, self.read(at, struct.calcsize(kind)))

    def rows(self, kind: np.dtype, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.read(at, count * kind.itemsize), kind, count) if count else np.zeros(0, kind)

    def find(self, what: bytes, at: int = 0) -> int:
        if not isinstance(self.held, int):
            found = self.held.find(what, self.at + at, self.at + self.size)
            return found - self.at if found >= 0 else -1
        while at < self.size:
            found = self.read(at, BLOCK + len(what) - 1).find(what)
            if found >= 0:
                return at + found
            at += BLOCK
        return -1


def _spans(places: np.ndarray, extra: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Which places lie close together, and from where to where they are read, with so many bytes after the last."""
    order = np.argsort(places, kind="stable")
    held = places[order]
    at = 0
    for stop in [*(np.flatnonzero(np.diff(held) > GAP) + 1).tolist(), len(held)]:
        while at < stop:
            end = min(stop, int(np.searchsorted(held, held[at] + BLOCK, "right")))
            yield order[at:end], int(held[at]), int(held[end - 1]) + extra
            at = end


def _texts(raw: View, places: np.ndarray) -> list[str]:
    """The strings that start there; '' beyond the table."""
    out = [""] * len(places)
    known = np.flatnonzero((places >= 0) & (places < len(raw)))
    for which, low, high in _spans(places[known], 0):
        block = raw.read(low, high - low + GAP)
        if block.find(b"\0", high - low) < 0:  # the last is a long one
            end = raw.find(b"\0", high)
            if end < 0:
                raise ValueError("a name without an end")
            block = raw.read(low, end + 1 - low)
        ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 0)
        starts = places[known[which]] - low
        stops = ends[np.searchsorted(ends, starts)]
        for k, a, b in zip(known[which].tolist(), starts.tolist(), stops.tolist(), strict=True):
            out[k] = block[a:b].decode("utf-8", "replace")
    return out


def _text(raw: View, at: int) -> str:
    return _texts(raw, np.array([at], np.int64))[0]


def _fixed(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


#: Sections, addresses and names of some symbols.
Symbols = tuple[np.ndarray, np.ndarray, list[str]]


class Image:
    """What all formats give: sections (name, addr, size, file_backed, is_text, is_pclntab), symbols (sect, addr, name) in steps, the line table's bytes and the start of the text."""

    def __init__(self, kind: str):
        self.kind = kind
        self.sections: list[tuple[str, int, int, bool, bool, bool]] = []
        self.steps: Callable[[], Iterator[Symbols]] = lambda: iter(())
        self.table, self.text = View(b"", 0, 0), 0

    @property
    def symbols(self) -> list[tuple[int, int, str]]:
        return [(int(s), int(a), n) for step in self.steps() for s, a, n in zip(*step, strict=True)]


def _steps(table: View, kind: np.dtype, count: int, strings: View, sections: list, first: int, skipped: int = 0) -> Iterator[Symbols]:
    """Symbols of a table, whose sections count from first; those of no section or from before its start are left out."""
    bases = np.array([s[1] for s in sections], np.uint64)
    for at in range(skipped, count, STEP):
        found = table.rows(kind, at * kind.itemsize, min(STEP, count - at))
        sect = found["sect"].astype(np.int64) - first
        found, sect = found[(sect >= 0) & (sect < len(bases))], sect[(sect >= 0) & (sect < len(bases))]
        value = found["value"].astype(np.uint64)
        keep = value >= bases[sect]
        yield sect[keep], value[keep] - bases[sect[keep]], _texts(strings, found["name"][keep].astype(np.int64))


def elf(raw: bytes | View) -> Image:
    raw = View.of(raw)
    wide, order = raw.byte(4) == 2, "<" if raw.byte(5) == 1 else ">"
    header = raw.unpack(order + ("16sHHIQQQIHHHHHH" if wide else "16sHHIIIIIHHHHHH"), 0)
    at, size, count, names_in = header[6], header[11], header[12], header[13]
    rows = [raw.unpack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), at + k * size) for k in range(count)]
    body = [raw.sub(r[4], r[5] if r[1] != 8 else 0) for r in rows]
    out = Image("elf")
    names = [_text(body[names_in], r[0]) for r in rows] if rows else []
    for name, r in zip(names, rows, strict=True):
        out.sections.append((name, r[3], r[5], r[1] != 8, name == ".text", name == ".gopclntab"))
        if name == ".text":
            out.text = r[3]
    if ".gopclntab" in names:
        out.table = body[names.index(".gopclntab")]
    for k, r in enumerate(rows):
        if r[1] == 2:  # the symbol table; its first entry stands for none
            kind = [("name", "u4"), ("info", "u1"), ("other", "u1"), ("sect", "u2"), ("value", "u8"), ("size", "u8")] if wide else [("name", "u4"), ("value", "u4"), ("size", "u4"), ("info", "u1"), ("other", "u1"), ("sect", "u2")]
            kind = np.dtype(kind).newbyteorder(order)
            if len(body[k]) % kind.itemsize:
                raise ValueError("a table of symbols that ends within one")
            table, strings = body[k], body[r[6]]
            out.steps = lambda: _steps(table, kind, len(table) // kind.itemsize, strings, out.sections, 0, 1)
            break
    return out


def mach(raw: bytes | View) -> Image:
    raw = View.of(raw)
    wide = raw.read(0, 4) in (b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf")
    order = "<" if raw.byte(0) in (0xCF, 0xCE) else ">"
    commands = raw.unpack(order + "I", 16)[0]
    out, at, table = Image("mach-o"), 32 if wide else 28, None
    for _ in range(commands):
        command, size = raw.unpack(order + "II", at)
        if command in (0x19, 0x1):
            n = raw.unpack(order + "I", at + (64 if wide else 48))[0]
            step, first = (80, 72) if wide else (68, 56)
            for k in range(n):
                p = at + first + k * step
                name, segment = _fixed(raw.read(p, 16)), _fixed(raw.read(p + 16, 16))
                addr, length, offset = raw.unpack(order + ("QQI" if wide else "III"), p + 32)
                out.sections.append((f"{segment} {name}", addr, length, offset != 0, name == "__text", name == "__gopclntab"))
                if name == "__text":
                    out.text = addr
                if name == "__gopclntab":
                    out.table = raw.sub(offset, length)
        elif command == 0x2:
            table = raw.unpack(order + "IIII", at + 8)
        at += size
    if table:
        kind = np.dtype([("name", "u4"), ("type", "u1"), ("sect", "u1"), ("desc", "u2"), ("value", "u8" if wide else "u4")]).newbyteorder(order)
        out.steps = lambda: _steps(raw.sub(table[0]), kind, table[1], raw.sub(table[2], table[3]), out.sections, 1)
    return out


def pe(raw: bytes | View) -> Image:
    raw = View.of(raw)
    start = raw.unpack("<I", 0x3C)[0] + 4
    _, count, _, symbols_at, n_symbols, optional, _ = raw.unpack("<HHIIIHH", start)
    magic = raw.unpack("<H", start + 20)[0]
    if magic not in (0x10B, 0x20B):
        raise ValueError("a PE file without an optional header")
    base = raw.unpack("<Q", start + 44)[0] if magic == 0x20B else raw.unpack("<I", start + 48)[0]
    strings = raw.sub(symbols_at + 18 * n_symbols) if symbols_at else raw.sub(0, 0)
    out, bodies = Image("pe"), {}
    for k in range(count):
        p = start + 20 + optional + 40 * k
        name = _fixed(raw.read(p, 8))
        if name.startswith("/") and name[1:].isdigit():
            name = _text(strings, int(name[1:]))
        size, addr, stored, offset = raw.unpack("<IIII", p + 8)
        out.sections.append((name, addr, size, stored > 0, name == ".text", False))
        bodies.setdefault(name, raw.sub(offset, stored))
        if name == ".text":
            out.text = base + addr
    if ".text" not in bodies:
        raise ValueError("a PE file without a .text section")
    found = next((bodies[s].sub(at) for s in (".rdata", ".data", ".text") if s in bodies for at in _line_tables(bodies[s])), None)
    if not found:
        raise ValueError("a PE file without a line table")
    out.table = found
    out.steps = lambda: _pe_steps(raw.sub(symbols_at), n_symbols, strings, count)
    return out


def _pe_steps(table: View, count: int, strings: View, sections: int) -> Iterator[Symbols]:
    """Each record says how many that follow belong to it; addresses are those in the section."""
    kind = np.dtype([("zero", "<u4"), ("place", "<u4"), ("value", "<u4"), ("sect", "<i2"), ("type", "<u2"), ("kind", "u1"), ("aux", "u1")])
    skip = 0
    for at in range(0, count, STEP):
        found = table.rows(kind, at * kind.itemsize, min(STEP, count - at))
        aux, own, k = found["aux"].tolist(), [], skip
        while k < len(aux):
            own.append(k)
            k += 1 + aux[k]
        skip = k - len(aux)
        found = found[own]
        found = found[(found["sect"] > 0) & (found["sect"] <= sections)]
        apart = found["zero"] == 0
        names = np.empty(len(found), object)
        names[apart] = _texts(strings, found["place"][apart].astype(np.int64))
        names[~apart] = [_fixed(struct.pack("<II", z, p)) for z, p in zip(found["zero"][~apart].tolist(), found["place"][~apart].tolist(), strict=True)]
        yield found["sect"].astype(np.int64) - 1, found["value"].astype(np.uint64), names.tolist()


def _line_tables(raw: View) -> Iterator[int]:
    """Places, 8 bytes apart, where a line table's header may begin; older kinds first."""
    for magic in TABLE_MAGICS:
        at = raw.find(magic)
        while at >= 0:
            if at % 8 == 0 and at + 8 < len(raw) and raw.byte(at + 4) == raw.byte(at + 5) == 0 and raw.byte(at + 7) in (4, 8):
                yield at
                break
            at = raw.find(magic, at + 1)


def function_steps(table: bytes | View, text: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and bytes of the functions of a line table, in steps; those without bytes are left out."""
    table = View.of(table)
    magic = table.read(0, 4)
    if len(table) < 16 or magic not in TABLE_MAGICS and magic[::-1] not in TABLE_MAGICS:
        raise ValueError("not a line table")
    order = "<" if magic in TABLE_MAGICS else ">"
    kind = TABLE_MAGICS.index(magic if order == "<" else magic[::-1])
    size = table.byte(7)
    word = np.dtype(f"{order}u{size}")
    head = table.rows(word, 8, min(9, (len(table) - 8) // size)).astype(np.int64)
    count = int(head[0])
    if kind == 0:  # the functions follow the header, all places count from the start
        names, rows, cell = 0, 8 + size, word
        first = 0
    elif kind == 1:
        names, first, cell = int(head[2]), int(head[6]), word
        rows = first
    else:  # entries count from the text's start
        names, first, cell = int(head[3]), int(head[7]), np.dtype(f"{order}u4")
        rows = first
    skip = cell.itemsize if kind < 2 else 4
    if rows < 0 or rows + (2 * count + 1) * cell.itemsize > len(table):
        raise ValueError("a line table that ends within its functions")
    for at in range(0, count, STEP):
        n = min(STEP, count - at)
        found = table.rows(cell, rows + 2 * at * cell.itemsize, 2 * n + 1).astype(np.int64)
        sizes = np.diff(found[0::2])
        own = np.flatnonzero(sizes > 0)
        records = first + found[1::2][own] + skip
        places = np.zeros(len(own), np.int64)
        for which, low, high in _spans(records, 4):
            block = np.frombuffer(table.read(low, high - low), np.uint8)
            if low < 0 or len(block) < high - low:
                raise ValueError("a line table that ends within a record")
            cells = block[(records[which] - low)[:, None] + np.arange(4)]
            places[which] = np.ascontiguousarray(cells).view(f"{order}i4")[:, 0]
        yield _texts(table, names + places), sizes[own]


def functions(table: bytes | View, text: int) -> list[tuple[str, int]]:
    """(name, bytes) of the functions of a line table; those without bytes are left out."""
    return [(n, int(s)) for step in function_steps(table, text) for n, s in zip(*step, strict=True)]


def build_facts(raw: bytes | View) -> dict[str, str]:
    """system, arch, main_package, main_module from the build information, where it stands in the file itself."""
    raw = View.of(raw)
    out = dict.fromkeys(("system", "arch", "main_package", "main_module"), "")
    at = raw.find(BUILD_MAGIC)
    if at < 0 or at + 32 > len(raw) or not raw.byte(at + 15) & 2:
        return out
    at += 32
    for k in range(2):  # the toolchain's version, then the listing
        size = shift = 0
        while True:
            one = raw.byte(at)
            size |= (one & 127) << shift
            shift, at = shift + 7, at + 1
            if not one & 128:
                break
        listing, at = raw.read(at, size), at + size
    for line in listing[16:-16].decode("utf-8", "replace").split("\n"):
        parts = line.split("\t")
        if parts[0] == "path":
            out["main_package"] = parts[1]
        elif parts[0] == "mod":
            out["main_module"] = parts[1]
        elif parts[0] == "build" and parts[1].startswith("GOOS="):
            out["system"] = parts[1][5:]
        elif parts[0] == "build" and parts[1].startswith("GOARCH="):
            out["arch"] = parts[1][7:]
    return out


def image(raw: bytes | View) -> Image:
    raw = View.of(raw)
    magic = raw.read(0, 4)
    if magic in (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xfe\xed\xfa\xce"):
        return mach(raw)
    if magic == b"\x7fELF":
        return elf(raw)
    if magic[:2] == b"MZ":
        return pe(raw)
    raise ValueError("not an ELF, Mach-O or PE file")


_SECTION = pa.struct([("sect", pa.int32()), ("name", pa.string()), ("addr", pa.int64()), ("size", pa.int64()), ("file_backed", pa.bool_()), ("is_text", pa.bool_()), ("is_pclntab", pa.bool_())])
_SYMBOL = pa.struct([("sect", pa.int32()), ("addr", pa.int64()), ("name", pa.string())])
_FUNCTION = pa.struct([("name", pa.string()), ("size", pa.int64())])
_SCHEMA = pa.schema([("path", pa.string()), ("part", pa.int32()), ("format", pa.string()), ("file_size", pa.int64()), ("system", pa.string()), ("arch", pa.string()), ("main_package", pa.string()), ("main_module", pa.string()), ("stripped", pa.bool_()), ("sections", pa.list_(_SECTION)), ("symbols", pa.list_(_SYMBOL)), ("functions", pa.list_(_FUNCTION))])


def _cut(kind: pa.StructType, columns: list) -> pa.Array:
    """Lists of RUN rows of these columns."""
    n = len(columns[0])
    held = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([*range(0, n, RUN), n], pa.int32()), held)


def _rows(path: str, raw: View) -> Iterator[pa.RecordBatch]:
    """FILE rows of a file."""
    found = image(raw)
    steps, first, known = found.steps(), [], 0
    for step in steps:
        first.append(step)
        known += len(step[2])
        if known >= LEAST_SYMBOLS:
            break
    stripped = known < LEAST_SYMBOLS
    facts = {"path": path, "format": found.kind, "file_size": len(raw), "stripped": stripped} | build_facts(raw)
    sections = [{"sect": i, "name": s[0], "addr": s[1], "size": s[2], "file_backed": s[3], "is_text": s[4], "is_pclntab": s[5]} for i, s in enumerate(found.sections)]
    yield pa.RecordBatch.from_pylist([facts | {"part": 0, "sections": sections, "symbols": [], "functions": []}], schema=_SCHEMA)
    part = 1

    def rows(name: str, lists: pa.Array) -> pa.RecordBatch:
        n = len(lists)
        columns = {c: pa.repeat(pa.scalar(v, _SCHEMA.field(c).type), n) for c, v in facts.items()} | {"part": pa.array(range(part, part + n), pa.int32()), name: lists}
        empty = pa.array([0] * (n + 1), pa.int32())
        for c in ("sections", "symbols", "functions"):
            if c != name:
                columns[c] = pa.ListArray.from_arrays(empty, pa.array([], _SCHEMA.field(c).type.value_type))
        return pa.RecordBatch.from_arrays([columns[c] for c in _SCHEMA.names], schema=_SCHEMA)

    def each():
        yield from first
        first.clear()
        yield from steps

    for sect, addr, names in each():
        if names:
            lists = _cut(_SYMBOL, [sect, addr, pa.array(names, pa.string())])
            yield rows("symbols", lists)
            part += len(lists)
    for names, sizes in function_steps(found.table, found.text) if stripped else ():
        if names:
            lists = _cut(_FUNCTION, [pa.array(names, pa.string()), sizes])
            yield rows("functions", lists)
            part += len(lists)


def parsed(files: DataFrame) -> DataFrame:
    """FILE rows of files(path, content)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                yield from _rows(batch.column(0)[k].as_py(), View.of(batch.column(1)[k].as_py()))

    return files.select("path", "content").mapInArrow(run, FILE)


def gathered(pieces: DataFrame) -> DataFrame:
    """FILE rows of files that come in pieces(path, at, body), in any order; what lies between pieces is zero."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            names: dict[str, str] = {}
            for batch in batches:
                for path, at, body in zip(*(batch.column(k) for k in range(3)), strict=True):
                    name = names.setdefault(path.as_py(), os.path.join(folder, str(len(names))))
                    held = os.open(name, os.O_WRONLY | os.O_CREAT)
                    try:
                        left, at = memoryview(body.as_buffer()), at.as_py()
                        while left:
                            done = os.pwrite(held, left, at)
                            left, at = left[done:], at + done
                    finally:
                        os.close(held)
            for path, name in names.items():
                with open(name, "rb") as f:
                    yield from _rows(path, View(f.fileno(), 0, os.fstat(f.fileno()).st_size))
                os.remove(name)

    bounded(pieces.sparkSession)
    return pieces.select("path", "at", "body").repartition("path").mapInArrow(run, FILE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """FILE rows of the executables at path."""
    return parsed(spark.read.format("binaryFile").load(path))


def sections(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode("sections").alias("s")).select("path", "s.*")


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of the files that aren't stripped."""
    return files.filter("not stripped").select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def function_sizes(files: DataFrame) -> DataFrame:
    """path, name, size of the functions of stripped files."""
    return files.filter("stripped").select("path", F.explode("functions").alias("f")).select("path", "f.*")
