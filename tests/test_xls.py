"""xls files built here: chains of sectors, large and small streams, shared strings that run over records, each kind of cell."""

import struct

import pytest
from pyspark.sql import functions as F

from memlattice.sources import transfer
from memlattice.sources.xls import text_of

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def string(text, wide=False):
    return struct.pack("<HB", len(text), wide) + text.encode("utf-16-le" if wide else "latin-1")


def cell(kind, row, column, body):
    return record(kind, struct.pack("<HHH", row, column, 0) + body)


def book(sheets, shared, pad=0):
    """sheets: (name, records); shared: bodies of the shared strings' record and those that go on."""
    begin = record(0x809, b"\x00\x06\x05\x00" + bytes(12))
    strings = record(0xFC, shared[0]) + b"".join(record(0x3C, x) for x in shared[1:]) if shared else b""
    size = len(begin) + sum(12 + len(n) for n, _ in sheets) + len(strings) + 4
    head, body = begin, b""
    for name, rows in sheets:
        head += record(0x85, struct.pack("<IHBB", size + len(body), 0, len(name), 0) + name.encode())
        body += begin + rows + record(0x0A)
    return head + strings + record(0x0A) + body + bytes(pad)


def compound(stream, name="Workbook"):
    """A compound file with the stream in sectors, or in small ones where it is short; sectors stand in reverse to show that chains are followed."""
    cut = lambda b, n: [b[i : i + n].ljust(n, b"\0") for i in range(0, len(b), n)]
    small = len(stream) < 4096
    body = cut(stream, 64) if small else []
    parts = cut(b"".join(body) if small else stream, 512)
    n = len(parts)
    place = {i: 2 + n - 1 - i for i in range(n)}  # sector 0: table, 1: folder, then the stream backwards
    table = [0xFFFFFFFD, END] + [FREE] * n + ([END] if small else [])
    for i in range(n):
        table[place[i]] = place[i + 1] if i + 1 < n else END

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(49) + struct.pack("<II", start, size) + bytes(4)

    folder = entry("Root Entry", 5, place[0] if small else END, 64 * len(body)) + entry(name, 2, 0 if small else place[0], len(stream))
    sectors = [struct.pack("<128I", *table, *[FREE] * (128 - len(table))), folder.ljust(512, b"\0")] + [parts[n - 1 - i] for i in range(n)]
    if small:
        sectors.append(struct.pack("<128I", *range(1, len(body)), END, *[FREE] * (128 - len(body))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(14)
    head += struct.pack("<I4xIIIII", 1, 4096, n + 2 if small else END, 1 if small else 0, END, 0) + struct.pack("<109I", 0, *[FREE] * 108)
    return head + b"".join(sectors)


SHARED = [struct.pack("<II", 3, 3) + string("name") + struct.pack("<HB", 6, 0) + b"abc", b"\x01" + "d中文".encode("utf-16-le") + struct.pack("<HBH", 2, 8, 1) + b"ok" + bytes(4)]
ROWS = b"".join([
    cell(0xFD, 1, 1, struct.pack("<I", 0)), cell(0xFD, 1, 2, struct.pack("<I", 1)), cell(0xFD, 1, 4, struct.pack("<I", 2)),
    cell(0x203, 2, 1, struct.pack("<d", 2.5)), cell(0x27E, 2, 2, struct.pack("<I", (7 << 2) | 2)), cell(0x27E, 2, 3, struct.pack("<I", ((-125 << 2) | 3) & 0xFFFFFFFF)),
    record(0xBD, struct.pack("<HHHIHIH", 4, 1, 0, (1 << 2) | 2, 0, (2 << 2) | 2, 2)),
    cell(0x205, 4, 3, b"\x01\x00"), cell(0x205, 4, 4, b"\x07\x01"),
    cell(0x06, 5, 1, struct.pack("<d", 4.0) + bytes(6)), cell(0x06, 5, 2, b"\0\0\0\0\0\0\xff\xff" + bytes(6)), record(0x207, string("told")), cell(0x204, 5, 3, string("plain")),
])
TEXT = "# first\nname\tabcd中文\t\tok\n2.5\t7\t-1.25\t\n\t\t\t\n1\t2\ttrue\t#DIV/0!\n4\ttold\tplain\t\n# second"


@pytest.mark.parametrize("pad", [0, 9000])
@pytest.mark.parametrize("name", ["Workbook", "Book"])
def test_sheets_rows_and_cells(pad, name):
    assert text_of(compound(book([("first", ROWS), ("second", b"")], SHARED, pad), name)) == TEXT


def test_broken_files_are_refused():
    whole = compound(book([("first", ROWS)], SHARED, 9000))
    looped = bytearray(whole)
    looped[512 + 8 : 512 + 12] = struct.pack("<I", 2)  # the last sector of the stream's chain leads to itself
    for data in (b"", b"x", whole[:600], bytes(looped), compound(b"x", "Other"), compound(book([("first", ROWS)], SHARED[:1]))):
        with pytest.raises((ValueError, struct.error)):
            text_of(data)


def test_files_through_spark(spark):
    files = spark.createDataFrame([("a.XLS", bytearray(compound(book([("first", ROWS), ("second", b"")], SHARED)))), ("b.xls", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in transfer.extract_files(files).select("path", "text", F.col("error")).collect()}
    assert got == {"a.XLS": (TEXT, True), "b.xls": (None, False)}
