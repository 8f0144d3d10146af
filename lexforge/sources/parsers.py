"""Parsers of document formats into one flat table of sections.

Every parser returns (title, [section]); a section is a dict of level, number, heading, loinc and body.
The tree is kept as levels, from which parents follow.
"""

from __future__ import annotations

import html.parser
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from ..functions import outline
from . import legacy, pdf

#: Elements whose text is not content, and those that never have an end tag.
SKIPPED = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside", "svg", "iframe", "form"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# Keys of a JSON document that describe it.
DESCRIPTIVE = frozenset(("document_id", "id", "title", "document_name", "product_name", "product", "active_ingredient", "drug", "jurisdiction", "document_type", "version", "provenance", "openfda"))


def decode(content: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _section(heading: str, body: str, level: int = 1, number: str | None = None, loinc: str | None = None) -> dict:
    return {"level": level, "number": number, "heading": heading, "loinc": loinc, "body": body.strip()}


def _by_lines(text: str, is_heading) -> list[dict]:
    out: list[dict] = []
    lines: list[str] = []
    head = None

    def flush():
        if head or any(x.strip() for x in lines):
            out.append(_section(head.raw if head else "General Content", "\n".join(lines), head.level if head else 1, head.number if head else None))

    for line in text.splitlines():
        h = is_heading(line)
        if h:
            flush()
            head, lines = h, []
        else:
            lines.append(line)
    flush()
    return out


def parse_txt(content: bytes) -> tuple[str | None, list[dict]]:
    """Sections by heading lines, all on one level."""
    return None, [s | {"level": 1} for s in _by_lines(decode(content).strip(), outline.heading)]


def parse_md(content: bytes) -> tuple[str | None, list[dict]]:
    """Sections by Markdown headings with their levels; the title is the first of level 1."""
    found = _by_lines(decode(content).strip(), lambda line: outline.heading(line) if line.lstrip().startswith("#") else None)
    for s in found:
        if h := outline.heading(s["heading"]):
            s["heading"] = h.title
    title = next((s["heading"] for s in found if s["level"] == 1 and s["heading"] != "General Content"), None)
    return title, found


# Names by which a listed object gives its caption, its number and its text.
CAPTIONS, NUMBERS, BODIES = ("section", "heading", "title", "name"), ("section_number", "number"), ("content", "text", "raw_text")


def _shown(value, name: str) -> str:
    """A field's value as text: lists of texts line by line, objects field by field, the rest as JSON."""
    match value:
        case str():
            return value
        case list():
            return "\n".join(value) if all(isinstance(x, str) for x in value) else json.dumps(value, indent=2)
        case dict():
            lines = (f"{k}: {v}" if isinstance(v, (str, int, float)) else f"{k}:\n{json.dumps(v, indent=2)}" for k, v in value.items())
            return "\n".join((f"[JSON Path: $.{name}]", *lines))
    return f"{name}: {value}"


def _listed(entries: list) -> Iterator[dict]:
    """A section for each entry of a list; what an object does not name as its text is shown field by field."""
    for n, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            yield _section(f"Item {n}", str(entry))
            continue
        told = {kind: next((entry[k] for k in names if entry.get(k)), None) for kind, names in (("caption", CAPTIONS), ("number", NUMBERS))}
        body = next((entry[k] for k in BODIES if entry.get(k) is not None), None)
        if body is None:
            body = "\n".join(f"{k}: {v}" for k, v in entry.items() if k not in CAPTIONS + NUMBERS)
        yield _section(str(told["caption"] or f"Section {n}"), body if isinstance(body, str) else json.dumps(body, indent=2), 1, str(told["number"]) if told["number"] else None)


def parse_json(content: bytes) -> tuple[str | None, list[dict]]:
    """A list of sections, an object with ``sections``, or one section for each field that is no description."""
    data = json.loads(decode(content))
    match data:
        case {"results": [first, *_]}:
            data = first
    match data:
        case list(entries) | {"sections": list(entries)}:
            found = list(_listed(entries))
        case dict():
            fields = ((re.sub("_+", " ", k).title(), _shown(v, k)) for k, v in data.items() if k.lower() not in DESCRIPTIVE)
            found = [_section(caption, body) for caption, body in fields if body.strip()]
        case _:
            found = []
    title = data.get("title") or data.get("document_name") if isinstance(data, dict) else None
    return title, found or [_section("General Content", json.dumps(data, indent=2))]


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _flat(node) -> str:
    return " ".join("".join(node.itertext()).split())


def _xml_body(node) -> list[str]:
    """Paragraphs, lists and tables below a node, without those of nested sections."""
    out = []
    for child in node:
        tag = _local(child.tag)
        if tag in ("section", "component", "title", "code", "id"):
            continue
        if tag == "list":
            out += [f"* {_flat(x)}" for x in child if _flat(x)]
        elif tag == "table":
            rows = [[_flat(c) for c in r if _local(c.tag) in ("td", "th")] for r in child.iter() if _local(r.tag) == "tr"]
            if rows:
                out += ["| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]]
        elif tag == "paragraph" or not len(child):
            if _flat(child):
                out.append(_flat(child))
        else:
            out += _xml_body(child) or ([_flat(child)] if _flat(child) else [])
    return out


def parse_spl(content: bytes) -> tuple[str | None, list[dict]]:
    """Structured product labels: a section is named by its code's display name, else by its title."""
    return parse_xml(content, coded=True)


def parse_xml(content: bytes, coded: bool = False) -> tuple[str | None, list[dict]]:
    """Nested <section> elements with title, code and LOINC; other XML by its elements. coded: the code names them first."""
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", content[:4096]):
        content = re.sub(rb"<!(?:DOCTYPE[^>\[]*(?:\[.*?\])?|ENTITY[^>]*)>", b"", content, flags=re.S)
    root = ET.fromstring(content)
    out: list[dict] = []

    def visit(node, level: int) -> None:
        for child in node:
            if _local(child.tag) != "section":
                visit(child, level)
                continue
            code = next((x for x in child if _local(x.tag) == "code"), None)
            names = [next((_flat(x) for x in child if _local(x.tag) == "title" and _flat(x)), None), code.get("displayName") if code is not None else None]
            head = next(filter(None, reversed(names) if coded else names), "Section")
            h = outline.heading(head)
            out.append(_section(head, "\n\n".join(_xml_body(child)), level, h.number if h else None, code.get("code") if code is not None else None))
            visit(child, level + 1)

    visit(root, 1)
    title = next((_flat(x) for x in root if _local(x.tag) == "title" and _flat(x)), None)
    if not out:
        for child in root:
            if _local(child.tag) != "title" and _flat(child):
                out.append(_section(_local(child.tag).replace("_", " ").title(), "\n\n".join(_xml_body(child)) or _flat(child)))
    return title, out


class _Html(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.lines, self.text = None, [], [], []
        self.skip, self.head, self.inside, self.row, self.table = 0, None, None, None, None
        self.lists = []  # the open lists: the last number of an ordered one, else None

    def _line(self, mark: str = "") -> None:
        s = " ".join("".join(self.text).split())
        self.text = []
        if s:
            self.lines.append(mark + s)

    def _flush(self) -> None:
        self._line()
        if self.head or self.lines:
            level, name = self.head or (1, "General Content")
            h = outline.heading(name)
            self.out.append(_section(name, "\n\n".join(self.lines), level, h.number if h else None))
        self.head, self.lines = None, []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self.inside = tag
        elif tag == "title":
            self._line()
            self.inside = "title"
        elif tag == "table":
            self._line()
            self.table = []
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.text = []
        elif tag in ("p", "div", "li", "ul", "ol", "section", "article"):
            self._line()
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            elif tag == "li" and self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip or tag in VOID:
            return
        elif tag == self.inside:
            s = " ".join("".join(self.text).split())
            self.text, self.inside = [], None
            if tag == "title":
                self.title = s or None
            elif s:
                self.head = (int(tag[1]), s)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "tr" and self.row is not None:
            if self.table is not None and self.row:
                self.table.append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            if self.table:
                rows = [self.table[0], ["---"] * len(self.table[0]), *self.table[1:]]
                self.lines.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
            self.table = None
        elif tag == "li":
            self._line(f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "* ")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "body"):
            self._line()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_html(content: bytes) -> tuple[str | None, list[dict]]:
    """Sections by h1 to h6; lists and tables become Markdown. Void elements never open a skipped region."""
    p = _Html()
    p.feed(decode(content))
    p.close()
    p._flush()
    return p.title, p.out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# Number formats of lists that count.
_COUNTED = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "decimalZero")


def _numberings(content: bytes) -> dict[str, str]:
    """The number format of the first level of each list definition."""
    root = ET.fromstring(content)
    first = {a.get(f"{_W}abstractNumId"): next((f.get(f"{_W}val", "") for f in a.iter(f"{_W}numFmt")), "") for a in root.iter(f"{_W}abstractNum")}
    return {n.get(f"{_W}numId"): first.get(next((x.get(f"{_W}val") for x in n.iter(f"{_W}abstractNumId")), None), "") for n in root.iter(f"{_W}num")}


def parse_docx(content: bytes) -> tuple[str | None, list[dict]]:
    """Paragraphs and tables in body order; heading styles (or numbered headings) start sections."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        kinds = _numberings(z.read("word/numbering.xml")) if "word/numbering.xml" in z.namelist() else {}
    out, lines, head, title = [], [], None, None

    def flush():
        if head or lines:
            out.append(_section(head[1] if head else "General Content", "\n\n".join(lines), head[0] if head else 1, head[2] if head else None))

    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows:
                lines.append("\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
        elif node.tag == f"{_W}p":
            s = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
            style = next((x.get(f"{_W}val", "") for x in node.iter(f"{_W}pStyle")), "")
            if not s:
                continue
            m = re.fullmatch(r"Heading\s*(\d)", style, re.I)
            h = outline.heading(s)
            if style.lower() == "title":
                title = title or s
            elif m or (h and h.number):
                flush()
                head, lines = (int(m[1]) if m else h.level, s, h.number if h else None), []
            else:
                kind = kinds.get(next((x.get(f"{_W}val") for x in node.iter(f"{_W}numId")), None)) or style.lower()
                lines.append(("* " if "bullet" in kind else "1. " if kind in _COUNTED or "number" in kind else "") + s)
    flush()
    return title, out


def parse_doc(content: bytes) -> tuple[str | None, list[dict]]:
    """Legacy Word files: their text, with sections by heading lines."""
    return parse_txt(legacy.doc_text(content).encode())


def parse_pdf(content: bytes) -> tuple[str | None, list[dict]]:
    """Sections by heading lines across pages; each page begins with its mark."""
    pages = pdf.pdf_pages(content)
    if not any(pages):
        return None, [_section("General Content", pdf.SCANNED)]
    return None, _by_lines("\n".join(f"[Page {i + 1}]\n{p}" for i, p in enumerate(pages)), outline.heading)


PARSERS = {"pdf": parse_pdf, "txt": parse_txt, "md": parse_md, "json": parse_json, "xml": parse_xml, "html": parse_html, "docx": parse_docx, "spl": parse_spl, "doc": parse_doc}
