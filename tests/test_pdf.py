"""PDF files built here: object streams, character maps, page order, broken parts, scanned pages."""

import zlib

import pytest

from memlattice.sources.pdf import text_of

LONG = "Enough letters to be more than a scanned page would ever have, all told."


def stream(raw, told=b"", deflate=True):
    data = zlib.compress(raw) if deflate else raw
    return b"<< " + told + (b" /Filter /FlateDecode" if deflate else b"") + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def pdf(**objects):
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (int(n[1:]), body) for n, body in objects.items()) + b"\n%%EOF"


def packed(objects):
    """An object stream of (number, body)."""
    at, head, body = 0, b"", b""
    for n, b in objects:
        head += b"%d %d " % (n, at)
        body += b + b" "
        at += len(b) + 1
    return stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)))


def page(text):
    return stream(b"BT /F1 9 Tf (" + text.encode("cp1252") + b") Tj ET")


def test_pages_come_in_the_order_of_their_tree_and_from_object_streams():
    tree = [(1, b"<< /Type /Pages /Kids [ 3 0 R 2 0 R ] /Count 2 >>"), (2, b"<< /Type /Page /Parent 1 0 R /Contents [ 5 0 R 6 0 R ] >>"), (3, b"<< /Type /Page /Parent 1 0 R /Contents 4 0 R >>")]
    data = pdf(o6=page("last"), o5=page("second ET page"), o4=page(LONG), o7=packed(tree))
    assert text_of(data) == f"{LONG}\nsecond ET page\nlast"


def test_fonts_with_character_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <4E2D> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<6587> <5B57>] endbfrange"
    objects = [(1, b"<< /Type /Pages /Kids [2 0 R] /Resources << /Font << /F1 4 0 R /F2 6 0 R >> >> >>"), (2, b"<< /Type /Page /Parent 1 0 R /Contents 3 0 R >>"), (4, b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"), (6, b"<< /Type /Font /Subtype /Type1 >>")]
    shown = stream(b"BT /F1 9 Tf <0001 0020 0021> Tj <00100011> Tj [<0012> -300 <0002>] TJ 0 -9 Td /F2 9 Tf (" + LONG.encode() + b") Tj ET")
    assert text_of(pdf(o3=shown, o5=stream(cmap), o8=packed(objects))) == f"\u4e2d\u6587\u5b57ABC fi\n{LONG}"


def test_odd_digits_nested_brackets_escapes_and_raw_streams():
    shown = rb"BT (a (nested \(one\)) \101\
b) Tj T* <41424> Tj (next) ' [(Wor) -20 (ld)] TJ T* (" + LONG.encode() + b") Tj ET (not shown) Tj"
    assert text_of(pdf(o1=stream(shown, deflate=False))) == f"a (nested (one)) Ab\nAB@\nnextWorld\n{LONG}"


def test_a_broken_stream_does_not_spoil_the_file():
    broken = stream(b"BT (gone) Tj ET")
    assert text_of(pdf(o1=broken.replace(b"stream\n\x78", b"stream\n\x00"), o2=page(LONG))) == LONG


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4", pdf(o1=page("short scan")), pdf(o1=page("x" * 49 + " " * 40)), pdf(o1=b"<< /Type /Pages /Kids [1 0 R 2 0 R] >>", o2=b"<< /Type /Page /Parent 2 0 R >>")])
def test_scanned_and_broken_files_are_refused(data):
    with pytest.raises(ValueError):
        text_of(data)


def test_fifty_characters_do():
    assert text_of(pdf(o1=page("x" * 50))) == "x" * 50
