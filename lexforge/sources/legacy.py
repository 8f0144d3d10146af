"""Text of legacy Word files (97 to 2003): the piece table in a compound file, by the published formats.

Defined results: files that are no compound file, hold no Word text or are encrypted raise ValueError;
fields keep their result and lose their instruction; cell marks become tabs.
"""

from __future__ import annotations

import re
import struct

_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END = 0xFFFFFFFA  # from here on sector numbers are marks


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != _MAGIC:
        raise ValueError("no parser for doc files other than compound ones")
    shift, small_shift = struct.unpack_from("<HH", data, 0x1E)
    first_directory, cutoff, first_small, _, first_extra, _ = (*struct.unpack_from("<I", data, 0x30), *struct.unpack_from("<IIIII", data, 0x38))
    size, small = 1 << shift, 1 << small_shift
    words = lambda block: list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    table_sectors = list(struct.unpack_from("<109I", data, 0x4C))
    extra, seen = first_extra, set()
    while extra < _END and extra not in seen:
        seen.add(extra)
        block = words(sector(extra))
        table_sectors += block[:-1]
        extra = block[-1]
    table = [x for n in table_sectors if n < _END for x in words(sector(n))]

    def chain(start: int, following: list[int], piece) -> bytes:
        out, seen = [], set()
        while start < _END and start < len(following) and start not in seen:
            seen.add(start)
            out.append(piece(start))
            start = following[start]
        return b"".join(out)

    directory = chain(first_directory, table, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, n = struct.unpack_from("<II", directory, at + 116)
        if kind in (2, 5):
            entries.append((directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, start, n))
    root = next((e for e in entries if e[1] == 5), None)
    held = chain(root[2], table, sector) if root else b""
    small_table = words(chain(first_small, table, sector))
    pick = lambda start, n: chain(start, small_table, lambda k: held[k * small : (k + 1) * small]) if n < cutoff else chain(start, table, sector)
    return {name: pick(start, n)[:n] for name, kind, start, n in entries if kind == 2}


def doc_text(data: bytes) -> str:
    """The main text of a legacy Word file."""
    found = streams(data)
    word = found.get("WordDocument", b"")
    if len(word) < 0x1AA or struct.unpack_from("<H", word)[0] != 0xA5EC:
        raise ValueError("no Word text")
    flags = struct.unpack_from("<H", word, 0x0A)[0]
    if flags & 0x0100:
        raise ValueError("encrypted")
    pieces = found.get("1Table" if flags & 0x0200 else "0Table", b"")
    start, length = struct.unpack_from("<II", word, 0x1A2)
    clx, at = pieces[start : start + length], 0
    while at < len(clx) and clx[at] == 1:  # formatting, not text
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", clx, at + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, at + 5)
    out = []
    for i in range(n):
        place = struct.unpack_from("<I", clx, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        characters = ends[i + 1] - ends[i]
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(word[begin : begin + characters].decode("cp1252", "replace"))
        else:
            out.append(word[place : place + 2 * characters].decode("utf-16-le", "replace"))
    text = "".join(out)[: struct.unpack_from("<I", word, 0x4C)[0] or None]
    while (less := re.sub(r"\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15", lambda m: m[1] or "", text)) != text:
        text = less
    text = text.replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n\n").replace("\x07", "\t").replace("\x1e", "-").replace("\x1f", "")
    return re.sub(r"[\x00-\x08\x0e-\x1d]", "", text)
