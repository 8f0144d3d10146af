"""Heading, list, table and sentence rules for code that walks a document line by line.

The rules and their fixed values are those of ``functions.text``; tests hold both against each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from . import text as X

_NUMBERED, _MARKDOWN, _BULLET, _ITEM = (re.compile(p) for p in (X.NUMBERED, X.MARKDOWN, X.BULLET, X.NUMBERED_ITEM))
_RULE = re.compile(r"^\s*\|?(?:\s*:?-+:?\s*\|)+\s*(?::?-+:?)?\s*\|?\s*$")
_HTML_TABLE = re.compile(r"<table\b.*?</table\s*>", re.I | re.S)
_STANDARD = frozenset(X.STANDARD_HEADINGS)

# Words behind whose full stop a sentence goes on.
ABBREVIATIONS = frozenset(("mg", "ml", "mcg", "kg", "g", "tab", "tabs", "cap", "caps", "meq", "iu", "oz", "tsp", "tbsp", "cm", "mm", "eg", "ie", "vs", "approx", "etc", "al", "cf", "viz", "dr", "prof", "mr", "mrs", "ms", "no", "nos", "ref", "sec", "vol", "fig", "para", "p", "pp"))
DOTTED = frozenset(("e.g.", "i.e.", "u.s.", "u.s.a.", "ph.d.", "m.d.", "s.p.l."))

_END = re.compile(r"([.?!])([\"')\]}]*)(\s+|$)")
_TOKEN = re.compile(r"[A-Za-z0-9._\-]+$")


@dataclass(frozen=True)
class Heading:
    raw: str
    number: str | None
    title: str
    level: int
    concept: str | None


def concept(title: str) -> str | None:
    for name, pattern in X.CONCEPTS.items():
        if re.search(rf"\b({pattern})\b", title, re.I):
            return name
    return None


def heading(line: str) -> Heading | None:
    """The heading in a line, by the first form that fits: Markdown, numbered, standard title, capitals."""
    clean = line.strip()
    if not clean or len(clean) > 200:
        return None
    if m := _MARKDOWN.match(clean):
        title = m[2].strip()
        inner = _NUMBERED.match(title)
        name = inner[2].strip() if inner else title
        return Heading(clean, inner[1] if inner else None, name, len(m[1]), concept(name))
    if m := _NUMBERED.match(clean):
        name = m[2].strip()
        return Heading(clean, m[1], name, m[1].count(".") + 1, concept(name))
    bare = clean.rstrip(":")
    named = concept(bare)
    n = len(bare.split())
    if bare.lower() in _STANDARD or (bare.isupper() and 1 <= n <= 10 and len(bare) <= 80 and (named or n >= 2)):
        return Heading(clean, None, bare, 1, named)
    return None


def list_item(line: str) -> tuple[str, str, str] | None:
    """(type, marker, content) of a list line."""
    clean = line.strip()
    if m := _BULLET.match(clean):
        return "bullet", m[1], m[2].strip()
    if m := _ITEM.match(clean):
        mark = m[1] or m[2]
        kind = "numbered_item" if mark.isdigit() else "roman_item" if re.fullmatch("[ivxcdmIVXCDM]+", mark) else "lettered_item"
        return kind, f"({mark})" if m[1] else f"{mark}.", m[3].strip()
    return None


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def tables(lines: list[str]) -> list[tuple[int, int, list[str], list[list[str]]]]:
    """(first line, end, headers, rows) of every pipe table: a header, a rule and rows of data."""
    out, i = [], 0
    while i + 1 < len(lines):
        if "|" not in lines[i] or not _RULE.match(lines[i + 1].strip()):
            i += 1
            continue
        names = cells(lines[i])
        headers = [h for h in names if h] if len(names) > 1 else names
        end = i + 2
        rows = []
        while end < len(lines) and "|" in lines[end] and not lines[end].strip().startswith("#"):
            row = cells(lines[end])
            rows.append((row + [""] * len(headers))[: len(headers)])
            end += 1
        if headers and rows:
            out.append((i, end, headers, rows))
        i = end
    return out


class _Tables(HTMLParser):
    """Rows of every closed HTML table; the first row that ends in a header cell is its header."""

    def __init__(self):
        super().__init__()
        self.found: list[tuple[str | None, list[str], list[list[str]]]] = []
        self.caption = None
        self.headers, self.rows, self.row, self.cell, self.head = [], [], None, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.caption, self.headers, self.rows = None, [], []
        elif tag == "caption":
            self.cell = []
        elif tag == "tr":
            self.row = []
        elif tag in ("th", "td"):
            self.head, self.cell = tag == "th", []

    def handle_endtag(self, tag):
        if tag == "caption":
            self.caption, self.cell = "".join(self.cell or []).strip(), None
        elif tag in ("th", "td"):
            if self.row is not None:
                self.row.append("".join(self.cell or []).strip())
            self.cell = None
        elif tag == "tr":
            if self.row and self.head and not self.headers:
                self.headers = self.row
            elif self.row:
                self.rows.append(self.row)
            self.row, self.head = None, False
        elif tag == "table":
            self.found.append((self.caption, self.headers, self.rows))
            self.caption, self.headers, self.rows = None, [], []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def _named(headers: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Headers for the longest row and rows filled up to them; a table without headers takes its first row's."""
    if not headers and len(rows) > 1:
        headers, rows = rows[0], rows[1:]
    width = max([len(headers), *map(len, rows)])
    return headers + [f"Column {j + 1}" for j in range(len(headers), width)], [r + [""] * (width - len(r)) for r in rows]


def html_tables(text: str) -> list[tuple[str | None, list[str], list[list[str]]]]:
    """(caption, headers, rows) of every HTML table with rows of data."""
    if "<table" not in text.lower():
        return []
    parser = _Tables()
    parser.feed(text)
    return [(c, *_named(h, r)) for c, h, r in parser.found if r]


def tsv_tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of runs of two lines or more with equally many tabs; blank lines do not end a run.

    Lines of pipe and HTML tables belong to no run.
    """
    if "\t" not in text:
        return []
    lines = _HTML_TABLE.sub(lambda m: "\n".join("<" for _ in m[0].splitlines()), text).splitlines()
    for first, end, _, _ in tables(lines):
        lines[first:end] = ["|"] * (end - first)
    runs: list[list[list[str]]] = []
    for line in filter(str.strip, lines):
        row = [c.strip() for c in line.split("\t")]
        if runs and len(runs[-1][0]) == len(row):
            runs[-1].append(row)
        else:
            runs.append([row])
    return [(r[0], r[1:]) for r in runs if len(r) > 1 and len(r[0]) > 1]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence); full stops of numbers, abbreviations, initials and list marks do not end one."""
    cuts = [0]
    for m in _END.finditer(text):
        dot = m.start()
        if m[1] == "." and _goes_on(text, dot, m.end()):
            continue
        cuts.append(dot + 1 + len(m[2]))
    cuts.append(len(text))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        s = text[a:b].strip()
        if s:
            start = a + text[a:b].index(s)
            out.append((start, start + len(s), s))
    return out


def _goes_on(text: str, dot: int, after: int) -> bool:
    """Whether the full stop at ``dot`` stands inside a sentence."""
    if text[dot + 1 : dot + 2] == ".":
        return True
    m = _TOKEN.search(text, max(0, dot - 60), dot)
    word = m[0] if m else ""
    low = word.lower()
    if low + "." in DOTTED or low in DOTTED or re.search(r"\b[a-z]\.[a-z]$", low) or re.sub(r"[^a-z0-9]", "", low) in ABBREVIATIONS:
        return True
    if len(word) == 1 and word.isupper() and dot > 1 and text[dot - 2].isalpha():
        return True
    line = text[text.rfind("\n", 0, dot) + 1 : dot].strip()
    if re.fullmatch(r"\d+|[a-zA-Z]|[ivxIVX]+", line):
        return True
    return after < len(text) and text[after].islower()
