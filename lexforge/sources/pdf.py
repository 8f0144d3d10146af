"""Text of PDF files with simple fonts: pages in order, lines by text position, flate streams.

Fonts that need an embedded character map are read through it where it is a plain one; encrypted files
are refused; a file without text yields the marker that fingerprints know as a scan.
"""

from __future__ import annotations

import re
import zlib

SCANNED = "No digital text layer detected. Image-only PDF"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _inflate(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    data = m[1]
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return data if b"/Filter" not in body[: m.start()] else b""


def _objects(content: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(found.values()):
        if b"/ObjStm" not in body:
            continue
        first, count = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"First", b"N"))
        data = _inflate(body)
        head = [int(x) for x in data[:first].split()[: 2 * count]]
        starts = head[1::2] + [len(data) - first]
        for i, number in enumerate(head[::2]):
            found.setdefault(number, data[first + starts[i] : first + starts[i + 1]])
    return found


def _reference(body: bytes, name: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in reading order: down the tree of the catalogue, else in file order."""
    out, seen = [], set()
    catalogue = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    todo = list(reversed(_reference(catalogue, b"Pages")))
    while todo:
        n = todo.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", objects[n]):
            todo += reversed(_reference(objects[n], b"Kids"))
        else:
            out.append(objects[n])
    return out or [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _string(token: bytes, cmap: dict[bytes, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if cmap:
        width = len(next(iter(cmap)))
        return "".join(cmap.get(raw[i : i + width], "") for i in range(0, len(raw), width))
    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _cmaps(objects: dict[int, bytes], page: bytes) -> dict[bytes, dict[bytes, str]]:
    """Character maps by font name of the page's fonts."""
    holder = page + b"".join(objects.get(n, b"") for n in _reference(page, b"Resources"))
    holder += b"".join(objects.get(n, b"") for n in _reference(holder, b"Font"))
    out = {}
    for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", holder):
        for at in _reference(objects.get(int(n), b""), b"ToUnicode"):
            table = {}
            data = _inflate(objects.get(at, b""))
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    table[bytes.fromhex(a.decode())] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
                for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    for k in range(min(int(z, 16) - int(a, 16), 65_535) + 1):
                        table[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = chr(int(b, 16) + k)
            if table:
                out[name] = table
    return out


def _text(stream: bytes, cmaps: dict[bytes, dict[bytes, str]]) -> str:
    out, stack, cmap, row = [], [], {}, None
    for token in _TOKEN.findall(stream):
        if token[:1] in b"(</[]" or re.fullmatch(rb"[-+.\d]+", token):
            stack.append(token)
            continue
        if token == b"Tf":
            cmap = next((cmaps.get(x[1:], {}) for x in stack if x[:1] == b"/"), {})
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_string(x, cmap))
                elif token == b"TJ" and re.fullmatch(rb"-\d+(\.\d*)?", x) and float(x) <= -200:
                    out.append(" ")
        elif token in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if float(stack[-1]) else " ")
        elif token == b"T*":
            out.append("\n")
        elif token == b"Tm" and len(stack) >= 6:
            out.append("\n" if stack[-1] != row else " ")
            row = stack[-1]
        elif token == b"ET":
            out.append("\n")
        stack = []
    return "".join(out)


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, lines trimmed and blank lines kept single."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("an encrypted PDF")
    objects = _objects(content)
    pages = []
    for page in _pages(objects):
        stream = b"\n".join(_inflate(objects.get(n, b"")) for n in _reference(page, b"Contents"))
        lines = [" ".join(x.split()) for x in _text(stream, _cmaps(objects, page)).splitlines()]
        pages.append(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip())
    return pages
