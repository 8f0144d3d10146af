"""Which format a file has: stated, by name, by MIME type, by its first bytes, else plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats by extension and MIME type.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "doc": "doc", "json": "json", "html": "html", "htm": "html", "xml": "xml", "md": "md", "markdown": "md", "txt": "txt"}
MIME_TYPES = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc", "application/json": "json",
    "text/html": "html", "application/xhtml+xml": "html", "application/xml": "xml", "text/xml": "xml", "text/markdown": "md", "text/plain": "txt",
}
# Hexadecimal first bytes of binary formats.
MAGIC = {"25504446": "pdf", "504B0304": "docx", "D0CF11E0": "doc"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def resolve(path: Column, content: Column, mime: Column | None = None, stated: Column | None = None) -> Column:
    """The format of a file; content is binary. Null path and content give txt."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^(?:\xEF\xBB\xBF)?\s+", ""))
    low = F.lower(text)
    sniffed = (
        F.when(F.rlike(low, F.lit(r"^<!doctype html|^<html")), "html")
        .when(F.rlike(low, F.lit(r"^<\?xml|^<document\b")), "xml")
        .when(F.rlike(text, F.lit(r"^[{\[]")), "json")
        .when(F.rlike(text, F.lit(r"(?m)^#{1,6}\s+\S")), "md")
    )
    extension = F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    options = [_lookup(F.lower(F.trim(stated)), EXTENSIONS)] if stated is not None else []
    options.append(_lookup(extension, EXTENSIONS))
    if mime is not None:
        options.append(_lookup(F.lower(F.trim(F.split(mime, ";")[0])), MIME_TYPES))
    # an archive is a Word file only if it lists the document part; one cut before its first entry may be
    kind = _lookup(head, MAGIC)
    binary = F.when((kind != "docx") | (F.octet_length(content) < 30) | F.contains(F.decode(content, "ISO-8859-1"), F.lit("word/document.xml")), kind)
    return F.coalesce(*options, binary, sniffed, F.lit("txt"))
