"""Text of PDF files: objects, also those packed in object streams; pages in the order of their tree; fonts with character maps."""

from __future__ import annotations

import re
import zlib

#: Fixed value: characters that aren't blank which a file has at least; one with fewer is taken for scanned images and refused.
LEAST = 50
#: A gap in thousandths of the letter height over which an array of strings has a blank.
GAP = 200

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*)\r?\n?endstream", re.S)
_STRING = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)"
_TOKEN = re.compile(_STRING + rb"|<[0-9A-Fa-f\s]*>|<<|>>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+\d?", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}


def _inflated(body: bytes) -> tuple[bytes, bytes | None]:
    """(dictionary, stream) of an object; of a broken stream what comes before the break, of other filters than deflate nothing."""
    found = _STREAM.search(body)
    if not found:
        return body, None
    told, raw = body[: found.start()], found[1]
    if b"/FlateDecode" in told or b"/Fl " in told:
        parts, z = [], zlib.decompressobj()
        try:
            for s in range(0, len(raw), 1 << 12):
                parts.append(z.decompress(raw[s : s + (1 << 12)]))
        except zlib.error:
            pass
        return told, b"".join(parts)
    return told, b"" if b"/Filter" in told else raw


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """All objects by number, the last of a number; what an object stream holds counts where no object of its own has the number."""
    own = {int(n): _inflated(body) for n, body in _OBJECT.findall(data)}
    packed: dict[int, tuple[bytes, bytes | None]] = {}
    for told, raw in own.values():
        first = re.search(rb"/First\s+(\d+)", told)
        if raw and first and b"/ObjStm" in told:
            at = [int(x) for x in re.findall(rb"\d+", raw[: int(first[1])])]
            ends = [*at[3::2], len(raw)]
            for n, s, e in zip(at[::2], at[1::2], ends, strict=False):
                packed[n] = (raw[int(first[1]) + s : int(first[1]) + e], None)
    return {**packed, **own}


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else _ESCAPES.get(m[1], m[1]), token[1:-1])


def _character_map(raw: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, text by code) of a font's map."""
    text = lambda h: _literal(h).decode("utf-16-be", "replace")
    code = lambda h: int.from_bytes(_literal(h), "big")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for a, b in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)", block):
            out[code(a)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for a, b, one, many in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)\s*(?:(<[^>]*>)|\[(.*?)\])", block, re.S):
            codes = range(code(a), min(code(b), code(a) + 65535) + 1)
            if one:
                start = text(one)
                out.update((c, start[:-1] + chr(ord(start[-1]) + k)) for k, c in enumerate(codes) if start)
            else:
                out.update(zip(codes, map(text, re.findall(rb"<[^>]*>", many)), strict=False))
    span = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", raw)
    return (len(span[1]) + 1) // 2 if span else 1, out


def _shown(raw: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """Text that a content stream shows, a line for each move to another one."""
    out: list[str] = []
    held: list[bytes | float] = []
    font, name, open_ = (1, {}), b"", False

    def said() -> str:
        parts = []
        for x in held:
            if isinstance(x, float):
                parts.append(" " if x < -GAP else "")
            elif font[1]:
                codes = [int.from_bytes(x[i : i + font[0]], "big") for i in range(0, len(x), font[0])]
                parts.append("".join(font[1].get(c, "") for c in codes))
            else:
                parts.append(x.decode("cp1252", "replace"))
        return "".join(parts)

    for token in _TOKEN.findall(raw):
        if token[:1] == b"(" or (token[:1] == b"<" and token != b"<<"):
            held.append(_literal(token))
        elif token[:1] == b"/":
            name = token[1:]
        elif token[:1] in b"-+.0123456789":
            held += [float(token)] if re.fullmatch(rb"[-+]?\d*\.?\d+", token) and any(isinstance(x, bytes) for x in held) else []
        elif token == b"BT":
            open_, held = True, []
        elif token == b"ET":
            open_, held = False, []
            out.append("\n")
        elif token[:1].isalpha() or token in (b"'", b'"', b"T*"):
            if token == b"Tf":
                font = fonts.get(name, (1, {}))
            elif open_ and token in (b"Td", b"TD", b"T*", b"Tm"):
                out.append("\n")
            elif open_ and token in (b"Tj", b"TJ", b"'", b'"'):
                out.append(("\n" if token in (b"'", b'"') else "") + said())
            held = []
    return "".join(out)


def text_of(data: bytes) -> str:
    """Text of a file's pages in order; an error where it has fewer than LEAST characters that aren't blank."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    objects = _objects(data)
    refs = lambda b: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R\b", b)]
    none: tuple[bytes, bytes | None] = (b"", None)

    def inner(told: bytes, key: bytes) -> bytes:
        """What stands under a key: the object that it names, or the rest of the dictionary from there."""
        found = re.search(key + rb"\s*(?:(\d+)\s+\d+\s+R\b|(?=<<|\[))", told)
        return b"" if not found else objects.get(int(found[1]), none)[0] if found[1] else told[found.end() :]

    def fonts(page: int) -> dict[bytes, tuple[int, dict[int, str]]]:
        """The fonts of a page by name, its own or those of the nodes above it."""
        seen: set[int] = set()
        while page not in seen:
            seen.add(page)
            told = objects.get(page, none)[0]
            named = inner(inner(told, rb"/Resources") or told, rb"/Font\b").split(b">>")[0]
            if named:
                break
            page = (refs(told[m.start() :])[:1] or [page])[0] if (m := re.search(rb"/Parent\b", told)) else page
        out = {}
        for name, n in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R\b", named):
            unicode = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(n), none)[0])
            raw = objects.get(int(unicode[1]), none)[1] if unicode else None
            if raw:
                out[name] = _character_map(raw)
        return out

    is_page = {n for n, (told, _) in objects.items() if re.search(rb"/Type\s*/Page\b", told)}
    order: list[int] = []
    open_ = [n for n, (told, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", told) and b"/Parent" not in told][::-1]
    seen: set[int] = set()
    while open_:
        n = open_.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in is_page:
            order.append(n)
        elif kids := re.search(rb"/Kids\s*\[(.*?)\]", objects.get(n, none)[0], re.S):
            open_ += refs(kids[1])[::-1]
    order += sorted(is_page - set(order))
    out = []
    for page in order:
        told = objects[page][0]
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", told, re.S)
        parts = refs(found[1]) if found else []
        if len(parts) == 1 and objects.get(parts[0], none)[1] is None:
            parts = refs(objects.get(parts[0], none)[0])  # an array of its own
        out.append(_shown(b"\n".join(objects.get(n, none)[1] or b"" for n in parts), fonts(page)))
    if not order:  # no page tree: what streams there are
        out = [_shown(raw, {}) for told, raw in objects.values() if raw and b"/ObjStm" not in told]
    text = re.sub(r"\n+", "\n", "\n".join(out)).strip()
    if sum(not c.isspace() for c in text) < LEAST:
        raise ValueError("too little text: scanned images can't be read")
    return text
