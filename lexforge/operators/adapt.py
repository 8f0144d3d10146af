"""Shapes of the same passage: chunks to items, items to documents.

Nothing is invented: what a chunk does not say stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as K


def chunks_to_items(chunks: DataFrame, with_facts: bool = True) -> DataFrame:
    """An item for each chunk; the page comes from its column, its location, or a page mark in the text.

    metadata keeps the chunk's place: parent, path, order, and table title and row of table rows.
    """
    located = F.regexp_extract("exact_location", r"(?i)(?:Pages?|p\.)\s*(\d+)", 1)
    marked = F.regexp_extract(F.trim("content"), r"(?i)^\[Page\s+(\d+)\]", 1)
    page = F.coalesce(F.col("page"), F.nullif(located, F.lit("")).try_cast("int"), F.nullif(marked, F.lit("")).try_cast("int"))
    tabular = F.coalesce((F.col("chunk_type") == "table_row") | F.contains(F.lower("exact_location"), F.lit("table")), F.lit(False))
    row = r"(?i)^(.*?),\s*Row\s+(\d+)"
    in_path = F.try_element_at(F.filter(F.transform(F.split("structure_path", ">"), F.trim), lambda p: F.rlike(p, F.lit(r"(?i)^table\b"))), F.lit(1))
    title = F.when(tabular, F.coalesce(F.nullif(F.trim(F.regexp_extract("exact_location", row, 1)), F.lit("")), in_path))
    entries = {
        "parent_chunk_id": F.col("parent_chunk_id"), "section_id": F.col("section_id"), "structure_path": F.col("structure_path"), "order_index": F.col("order_index").cast("string"),
        "jurisdiction": F.col("jurisdiction"), "document_type": F.col("document_type"), "normalized_section": F.col("normalized_section"),
        "table_title": title, "row_index": F.when(tabular, F.nullif(F.regexp_extract("exact_location", row, 2), F.lit(""))),
    }
    metadata = F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    facts = [c for c in K.key_information(F.col("content"))] if with_facts else []
    kept = ["population", "indication", "dose", "frequency", "route", "purpose"]
    base = chunks.withColumn("_k", F.struct(*facts)) if with_facts else chunks
    return base.select(
        F.col("chunk_id").alias("content_id"), "document_id", "document_fingerprint", "document_name", "source", "source_identifier", "version", F.col("section_title").alias("section"), F.col("section_number").alias("subsection"),
        page.alias("page"), "exact_location", "loinc_code", F.col("chunk_type").alias("content_type"), F.col("active_ingredient").alias("drug"), *([F.col(f"_k.{c}").alias(c) for c in kept] if with_facts else []), F.col("content").alias("text"), metadata.alias("metadata"),
    )


def items_to_sections(items: DataFrame, order: str, part=None) -> DataFrame:
    """(document_id, section, part, position, text): each document's items joined by section, in first-seen order.

    A text must fit one row: part (a column, such as a range of pages) cuts large sections into several.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content_id").alias("c"), F.col("text").alias("t"))))
    rows = items.where("document_id is not null and text is not null").groupBy("document_id", F.coalesce("section", F.lit("General Content")).alias("section"), (part if part is not None else F.lit(0)).alias("part"))
    return rows.agg(F.min(order).alias("position"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def sections_to_items(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """An item for each section: its text, else its heading; location, path and provenance from section and document.

    sections: document_id, section_id, section_number, heading, body, and optionally parent path as
    structure_path; documents: document_id, document_name, source, source_identifier, drug.
    """
    path = F.col("structure_path") if "structure_path" in sections.columns else F.lit(None).cast("string")
    of = documents.select("document_id", "document_name", "source", "source_identifier", "drug").dropDuplicates(["document_id"])
    rows = sections.where("document_id is not null").join(of, "document_id", "left")
    location = F.when(F.col("section_number").isNotNull(), F.concat(F.lit("Section "), "section_number")).otherwise(F.col("heading"))
    return rows.select(F.col("section_id").alias("content_id"), "document_id", "document_name", "source", "source_identifier", F.col("heading").alias("section"), F.col("section_number").alias("subsection"), location.alias("exact_location"), path.alias("structure_path"), F.lit("regulatory_section").alias("content_type"), "drug", F.coalesce("body", "heading").alias("text"))


def documents_to_items(documents: DataFrame, chunks: DataFrame, sections: DataFrame, text: str = "text") -> DataFrame:
    """Items of every document by what it has: its chunks, else its sections, else its whole text.

    documents: document_id, document_name, source, source_identifier, drug and text. Documents without any
    of the three give no item; what a branch does not say is null.
    """
    known = documents.where("document_id is not null")
    chunked = chunks.where("document_id is not null").select("document_id").distinct()
    cut = sections.join(chunked, "document_id", "left_anti")
    taken = chunked.unionByName(cut.select("document_id")).distinct()
    from_chunks = chunks_to_items(chunks.where("document_id is not null"), with_facts=False).join(known.select("document_id").distinct(), "document_id", "left_semi")
    from_sections = sections_to_items(cut, known).join(known.select("document_id").distinct(), "document_id", "left_semi")
    whole = known.join(taken, "document_id", "left_anti").where(F.trim(text) != "").dropDuplicates(["document_id"])
    from_text = whole.select(F.concat(F.lit("rc_"), "document_id").alias("content_id"), "document_id", "document_name", "source", "source_identifier", F.lit("General Content").alias("section"), F.lit("general_regulatory_content").alias("content_type"), "drug", F.trim(text).alias("text"))
    branch = lambda df, name: df.withColumn("branch", F.lit(name))
    return branch(from_chunks, "chunks").unionByName(branch(from_sections, "sections"), allowMissingColumns=True).unionByName(branch(from_text, "text"), allowMissingColumns=True)


def items_to_chunks(items: DataFrame) -> DataFrame:
    """A chunk for each item: ids, section and path as the item's metadata tells, else built from the item.

    metadata (a map, if there is one) may hold chunk_id, document_id, section_id, parent_chunk_id, chunk_type,
    order_index, structure_path and normalized_section.
    """
    has = dict(items.dtypes).get("metadata", "").startswith("map")
    meta = lambda n: F.nullif(F.try_element_at("metadata", F.lit(n)), F.lit("")) if has else F.lit(None).cast("string")
    column = lambda n: F.col(n) if n in items.columns else F.lit(None).cast("string")
    label = F.trim(F.concat_ws(" ", column("subsection"), column("section")))
    location = F.when(~column("exact_location").eqNullSafe(column("section")), column("exact_location"))
    built = F.nullif(F.concat_ws(" > ", F.nullif(column("document_name"), F.lit("")), F.when(column("section").isNotNull(), label), location), F.lit(""))
    return items.where("content_id is not null").select(
        F.coalesce(meta("chunk_id"), "content_id").alias("chunk_id"), F.coalesce(column("document_id"), meta("document_id"), F.concat(F.lit("doc_"), "content_id")).alias("document_id"),
        F.coalesce(meta("section_id"), F.concat(F.lit("sec_"), "content_id")).alias("section_id"), meta("parent_chunk_id").alias("parent_chunk_id"),
        F.coalesce(meta("chunk_type"), column("content_type"), F.lit("paragraph")).alias("chunk_type"), F.coalesce(meta("order_index").try_cast("int"), F.lit(0)).alias("order_index"),
        F.coalesce(meta("structure_path"), built, column("section"), F.lit("Document")).alias("structure_path"), F.col("text").alias("content"), meta("normalized_section").alias("normalized_section"),
        *[column(n).alias(m) for n, m in (("document_name", "document_name"), ("drug", "active_ingredient"), ("section", "section_title"), ("subsection", "section_number"), ("source", "source"), ("source_identifier", "source_identifier"), ("version", "version"), ("exact_location", "exact_location"), ("loinc_code", "loinc_code"))],
        (F.col("page").cast("int") if "page" in items.columns else F.lit(None).cast("int")).alias("page"),
    )


def as_items(rows: DataFrame) -> DataFrame:
    """Rows in the shape of items, whichever they have: chunks are turned, items stay."""
    return chunks_to_items(rows, with_facts=False) if "chunk_id" in rows.columns and "content_id" not in rows.columns else rows
