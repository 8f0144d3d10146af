"""Documents to sections to chunks: table rows, list items with their stems, fields and paragraphs.

A document is walked once, in Arrow batches; nothing is shuffled. Within a section chunks come in the
order tables, lists, paragraphs.

Defined results: null ids or texts give no row; text before the first heading is the section "General
Content"; paragraphs under ``least`` characters are dropped unless they are fields; paragraphs over
``most`` are packed sentence by sentence, each part repeating the last ``overlap`` sentences of the one
before, and a single longer sentence stays whole; repeated rows give repeated chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outline

_FIELD = re.compile(r"^[A-Z0-9_\-\s]{2,30}\s*:\s*[^\n]+$")

SECTIONS = "document_id string, section_id string, parent_section_id string, order_index int, level int, section_number string, heading string, concept string, body string"
CHUNKS = "chunk_id string, document_id string, section_id string, parent_chunk_id string, chunk_type string, order_index int, structure_path string, exact_location string, content string"


def section_id(document_id: str, order: int, name: str) -> str:
    return f"sec_{document_id}_{order}_{re.sub('[^a-zA-Z0-9]', '_', name.lower())[:20]}"


def chunk_id(document_id: str, section: str, kind: str, order: int, content: str) -> str:
    return "chk_" + hashlib.sha256(f"{document_id}:{section}:{kind}:{order}:{content[:64]}".encode()).hexdigest()[:12]


def sections_of(document_id: str, text: str) -> Iterator[dict]:
    """Sections in order; the parent is the last section before of a lesser level."""
    found: list[tuple[outline.Heading | None, list[str]]] = [(None, [])]
    for line in text.strip().splitlines():
        h = outline.heading(line)
        if h:
            found.append((h, []))
        else:
            found[-1][1].append(line)
    if not found[0][1]:
        found.pop(0)
    stack: list[tuple[int, str]] = []
    for order, (h, lines) in enumerate(found):
        name = h.raw if h else "General Content"
        sid = section_id(document_id, order, (h and h.number) or name)
        level = h.level if h else 1
        while stack and stack[-1][0] >= level:
            stack.pop()
        yield {
            "document_id": document_id, "section_id": sid, "parent_section_id": stack[-1][1] if stack else None, "order_index": order, "level": level,
            "section_number": h.number if h else None, "heading": name, "concept": h.concept if h else None, "body": "\n".join(lines).strip(),
        }
        stack.append((level, sid))


def pack(paragraph: str, most: int, overlap: int) -> list[str]:
    """Sentences packed into parts of at most ``most`` characters."""
    if len(paragraph) <= most:
        return [paragraph]
    parts: list[list[str]] = [[]]
    size = 0
    for _, _, s in outline.sentences(paragraph):
        if parts[-1] and size + len(s) > most:
            parts.append(parts[-1][len(parts[-1]) - overlap :] if overlap else [])
            size = sum(len(x) + 1 for x in parts[-1])
        parts[-1].append(s)
        size += len(s) + 1
    return [" ".join(p) for p in parts]


def chunks_of(section: dict, title: str, most: int = 1500, least: int = 25, overlap: int = 1) -> Iterator[dict]:
    """The chunks of one section."""
    number, name = section["section_number"], section["heading"]
    path = f"{title} > {number + ' ' if number else ''}{name}"
    order = 0

    def chunk(kind: str, where: str, place: str, content: str, parent: str | None = None) -> dict:
        nonlocal order
        row = {
            "chunk_id": chunk_id(section["document_id"], section["section_id"], kind, order, content), "document_id": section["document_id"], "section_id": section["section_id"], "parent_chunk_id": parent,
            "chunk_type": kind, "order_index": order, "structure_path": f"{path} > {where}", "exact_location": place, "content": content,
        }
        order += 1
        return row

    lines = section["body"].splitlines()
    used: set[int] = set()
    for first, end, headers, rows in outline.tables(lines):
        used.update(range(first, end))
        for i, row in enumerate(rows):
            content = " | ".join(f"{h}: {v}" if v else h for h, v in dict(zip(headers, row)).items())
            yield chunk("table_row", f"Table > Row {i + 1}", f"Table, Row {i + 1}", content)
    for caption, headers, rows in outline.html_tables(section["body"]):
        title = caption or "Table"
        for i, row in enumerate(rows):
            content = " | ".join(f"{h}: {v}" if v else h for h, v in dict(zip(headers, row)).items())
            if content.strip():
                yield chunk("table_row", f"{title} > Row {i + 1}", f"{title}, Row {i + 1}", content)
    # lists run across blank lines; the line before the first item is their stem if it ends with a colon
    groups: list[tuple[int | None, list[tuple[int, tuple[str, str, str]]]]] = []
    open_group, last = False, None
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        item = outline.list_item(line)
        if item:
            if not open_group:
                groups.append((last if last is not None and lines[last].strip().endswith(":") else None, []))
                open_group = True
            groups[-1][1].append((i, item))
        else:
            open_group, last = False, i
    # a paragraph line that repeats a list line or stem is dropped with it
    gone = {lines[i].strip() for stem, items in groups for i in [*([stem] if stem is not None else []), *(j for j, _ in items)]}
    for stem, items in groups:
        parent = None
        if stem is not None and len(lines[stem].strip()) >= least:
            row = chunk("paragraph", "Stem", "Paragraph (Stem)", lines[stem].strip())
            parent = row["chunk_id"]
            yield row
        for _, (kind, mark, content) in items:
            yield chunk("bullet" if kind == "bullet" else "numbered_item", f"Item {mark}", f"List Item {mark}", content, parent)
    rest = "\n".join("" if i in used else x for i, x in enumerate(lines) if i in used or x.strip() not in gone)
    for i, paragraph in enumerate(p.strip() for p in re.split(r"\n\s*\n", rest) if p.strip()):
        if _FIELD.match(paragraph) and len(paragraph) < 120:
            place = f"Field ({paragraph.split(':')[0].strip()})"
            yield chunk("structured_field", place, place, paragraph)
        elif len(paragraph) >= least:
            parts = pack(paragraph, most, overlap)
            for k, part in enumerate(parts):
                place = f"Paragraph {i + 1}" + (f" (Part {k + 1})" if len(parts) > 1 else "")
                yield chunk("paragraph", place, place, part)


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    """make(row) for every row of string columns, as a DataFrame."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int32() if f.split()[1] == "int" else pa.string() for f in schema.split(", ")]
    arrow = pa.schema(list(zip(names, types)))

    def run(batches):
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in make(row)]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 20_000], schema=arrow)

    return df.mapInArrow(run, schema)


def sections(docs: DataFrame, document_id: str, text: str) -> DataFrame:
    """Sections (columns SECTIONS) of every document."""
    rows = docs.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(F.col(document_id).cast("string"), F.col(text))
    return _rows(rows, lambda r: sections_of(*r), SECTIONS)


def chunk_documents(docs: DataFrame, document_id: str, text: str, title: str, most: int = 1500, least: int = 25, overlap: int = 1) -> DataFrame:
    """Chunks (columns CHUNKS) of every document."""
    rows = docs.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(F.col(document_id).cast("string"), F.col(text), F.coalesce(title, F.lit("Document")))
    return _rows(rows, lambda r: (c for s in sections_of(r[0], r[1]) for c in chunks_of(s, r[2], most, least, overlap)), CHUNKS)


def sentence_spans(docs: DataFrame, document_id: str, text: str) -> DataFrame:
    """(document_id, sentence_no, start_char, end_char, sentence) of every text."""
    rows = docs.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(F.col(document_id).cast("string"), F.col(text))
    names = ("document_id", "sentence_no", "start_char", "end_char", "sentence")
    return _rows(rows, lambda r: (dict(zip(names, (r[0], i, *s))) for i, s in enumerate(outline.sentences(r[1]))), "document_id string, sentence_no int, start_char int, end_char int, sentence string")


def table_rows(docs: DataFrame, document_id: str, text: str) -> DataFrame:
    """(document_id, table_no, row_no, header, value): the cells of every pipe, then HTML, then TSV table."""
    rows = docs.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(F.col(document_id).cast("string"), F.col(text))

    def make(r):
        piped = [(headers, data) for _, _, headers, data in outline.tables(r[1].splitlines())]
        for t, (headers, data) in enumerate([*piped, *(t[1:] for t in outline.html_tables(r[1])), *outline.tsv_tables(r[1])]):
            for i, row in enumerate(data):
                for h, v in zip(headers, row):
                    yield {"document_id": r[0], "table_no": t, "row_no": i, "header": h, "value": v}

    return _rows(rows, make, "document_id string, table_no int, row_no int, header string, value string")
