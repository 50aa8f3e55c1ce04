"""Text of xls workbooks: the compound file's sector chains, and the records of its workbook stream."""

from __future__ import annotations

import struct

#: Fixed values of the format: the end of a chain, and kinds of records.
END = 0xFFFFFFFA
SHEET, SHARED, MORE, STOP, BEGIN = 0x85, 0xFC, 0x3C, 0x0A, 0x809
LABEL, SHARED_LABEL, NUMBER, PACKED, PACKED_ROW, LOGICAL, FORMULA, STRING = 0x204, 0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def _stream(data: bytes) -> bytes:
    """The workbook stream of a compound file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not an xls file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    root, least, tiny, _, more = struct.unpack_from("<I4xIIII", data, 48)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    ints = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])

    def chain(at: int, table: list[int], read) -> bytes:  # noqa: ANN001
        parts, seen = [], 0
        while at < END:
            seen += 1
            if at >= len(table) or seen > len(table):
                raise ValueError("a chain of sectors is broken")
            parts.append(read(at))
            at = table[at]
        return b"".join(parts)

    places = list(ints(data[76:512]))
    while more < END:
        held = ints(sector(more))
        if len(places) > len(data) // 4 or not held:
            raise ValueError("a chain of sectors is broken")
        places += held[:-1]
        more = held[-1]
    table = [x for n in places if n < END for x in ints(sector(n))]
    folder = chain(root, table, sector)
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        n, kind = struct.unpack_from("<HB", folder, at + 64)
        if kind:
            entries[folder[at : at + max(0, n - 2)].decode("utf-16-le", "replace")] = struct.unpack_from("<II", folder, at + 116)
    found = entries.get("Workbook") or entries.get("Book")
    if not found:
        raise ValueError("no workbook in the file")
    if found[1] >= least:
        return chain(found[0], table, sector)[: found[1]]
    whole = chain(struct.unpack_from("<I", folder, 116)[0], table, sector)
    return chain(found[0], list(ints(chain(tiny, table, sector))), lambda n: whole[n * small : (n + 1) * small])[: found[1]]


class _Runs:
    """Bytes that run over several records. Characters that go on in the next record begin with a byte that tells their width anew."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def _left(self) -> int:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        if self.part >= len(self.parts):
            raise ValueError("the shared strings end early")
        return len(self.parts[self.part]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            k = min(n - len(out), self._left())
            out += self.parts[self.part][self.at : self.at + k]
            self.at += k
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        skip = 4 * struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        skip += struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while n:
            part = self.part
            left = self._left()
            if self.part != part:
                wide, left = self.take(1)[0] & 1, left - 1
            k = min(n, left // (1 + wide)) or 1
            out.append(self.take(k * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= k
        self.take(skip)
        return "".join(out)


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _packed(n: int) -> float:
    """A number of 30 bits: whole or the upper bits of a double, and a hundredth of it where the lowest bit is set."""
    x = float((n ^ 0x80000000) - 0x80000000 >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return x / 100 if n & 1 else x


def text_of(data: bytes) -> str:
    """Sheets in their order, each a line `# name` and a line for each row from the first to the last with cells, cells parted by tabs."""
    book = _stream(data)
    sheets: list[tuple[str, int]] = []
    shared: list[str] = []

    def records(at: int):  # noqa: ANN202
        while at + 4 <= len(book):
            kind, n = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + n]
            at += 4 + n
            if kind == STOP:
                return

    runs: list[bytes] | None = None
    for kind, body in records(0):
        if kind == SHEET:
            n, wide = body[6], body[7] & 1
            sheets.append((body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"), struct.unpack_from("<I", body)[0]))
        runs = [body] if kind == SHARED else runs
        if kind == MORE and runs:
            runs.append(body)
    if runs:
        count = struct.unpack_from("<I", runs[0], 4)[0]
        reader = _Runs([runs[0][8:], *runs[1:]])
        shared = [reader.string() for _ in range(count)]
    out = []
    for name, start in sheets:
        cells: dict[tuple[int, int], str] = {}
        asked = None  # the cell of a formula whose text comes in the next record
        for kind, body in records(start):
            at = struct.unpack_from("<HH", body) if len(body) >= 4 else (0, 0)
            if kind == SHARED_LABEL:
                cells[at] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == LABEL:
                cells[at] = _Runs([body[6:]]).string()
            elif kind == NUMBER:
                cells[at] = _number(struct.unpack_from("<d", body, 6)[0])
            elif kind == PACKED:
                cells[at] = _number(_packed(struct.unpack_from("<I", body, 6)[0]))
            elif kind == PACKED_ROW:
                cells.update(((at[0], at[1] + i), _number(_packed(struct.unpack_from("<I", body, 6 + 6 * i)[0]))) for i in range((len(body) - 6) // 6))
            elif kind == LOGICAL:
                cells[at] = ERRORS.get(body[6], "#?") if body[7] else "true" if body[6] else "false"
            elif kind == FORMULA and body[12:14] == b"\xff\xff":
                asked = at if body[6] == 0 else None
                cells[at] = {1: "true" if body[8] else "false", 2: ERRORS.get(body[8], "#?")}.get(body[6], "")
            elif kind == FORMULA:
                cells[at] = _number(struct.unpack_from("<d", body, 6)[0])
            elif kind == STRING and asked:
                cells[asked] = _Runs([body]).string()
        out.append(f"# {name}")
        if cells:
            rows, columns = [r for r, _ in cells], [c for _, c in cells]
            out += ["\t".join(cells.get((r, c), "") for c in range(min(columns), max(columns) + 1)) for r in range(min(rows), max(rows) + 1)]
    return "\n".join(out)
