"""Files of mixed formats to documents, sections and items; openFDA-shaped label payloads to items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import stage
from . import formats, parsers

SECTIONS = "document_id string, title string, format string, order_index int, parent_index int, level int, section_number string, heading string, loinc_code string, body string, error string"

# Sections of a label payload and their titles.
LABEL_SECTIONS = {
    "indications_and_usage": "Indications and Usage", "dosage_and_administration": "Dosage and Administration", "warnings": "Warnings", "warnings_and_cautions": "Warnings and Cautions",
    "contraindications": "Contraindications", "adverse_reactions": "Adverse Reactions", "drug_interactions": "Drug Interactions", "use_in_specific_populations": "Use in Specific Populations",
    "overdosage": "Overdosage", "description": "Description", "clinical_pharmacology": "Clinical Pharmacology",
}
#: Characters of a label section that an item keeps.
ITEM_CHARS = 4000


def _kept(text: str, chars: int | None) -> Column:
    return F.col(text) if chars is None else F.left(text, F.lit(chars))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def parse_files(files: DataFrame, document_id: str = "path", content: str = "content", path: str = "path", fmt: str | None = None) -> DataFrame:
    """Sections (columns SECTIONS) of every file; a file that cannot be read is one row with its error.
    """
    schema = pa.schema([(f.split()[0], pa.int32() if f.split()[1] == "int" else pa.string()) for f in SECTIONS.split(", ")])
    names = schema.names

    def run(batches):
        for b in batches:
            out = []
            for doc, data, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    if kind not in parsers.PARSERS:
                        raise ValueError(f"no parser for {kind}")
                    title, found = parsers.PARSERS[kind](data)
                except Exception as e:  # a broken file must not end the job
                    out.append(dict.fromkeys(names) | {"document_id": doc, "format": kind, "error": f"{type(e).__name__}: {e}"[:300]})
                    continue
                stack: list[tuple[int, int]] = []
                for i, s in enumerate(found):
                    while stack and stack[-1][0] >= s["level"]:
                        stack.pop()
                    parent = stack[-1][1] if stack else None
                    stack.append((s["level"], i))
                    out.append({"document_id": doc, "title": title, "format": kind, "order_index": i, "parent_index": parent, "level": s["level"], "section_number": s["number"], "heading": s["heading"], "loinc_code": s["loinc"], "body": s["body"], "error": None})
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=schema)

    kind = F.col(fmt) if fmt else formats.resolve(F.col(path), F.col(content))
    rows = files.where(F.col(document_id).isNotNull() & F.col(content).isNotNull())
    return rows.select(F.col(document_id).cast("string"), F.col(content), kind.alias("_format")).mapInArrow(run, SECTIONS)


def ingest(files: DataFrame, path: str = "path", content: str = "content", document_id: str | None = None, source: str = "InternalDraft") -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of files of any format.

    documents: document_id (given, else from path and bytes), document_name (the file's own title, else its
    name without suffix in words), fingerprint of all its text (of its bytes where it has none), source,
    source_identifier, source_url, version, n_sections, format and error; one row a file.
    """
    name = F.element_at(F.split(F.col(path), "[/\\\\]"), -1)
    own = F.concat(F.lit("doc_"), F.left(F.sha2(F.concat(F.coalesce(F.encode(F.col(path), "UTF-8"), F.lit(b"")), F.coalesce(F.col(content), F.lit(b""))), 256), F.lit(10)))
    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content"), (F.coalesce(F.col(document_id), own) if document_id else own).alias("document_id")).where("content is not null")
    sections = stage(parse_files(rows, "document_id"), "sections")
    # the texts of one document, in order; a document fits a row, as its file did
    texts = sections.groupBy("document_id").agg(F.first("title", ignorenulls=True).alias("title"), F.first("format").alias("format"), F.max("error").alias("error"), F.count("order_index").alias("n_sections"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "body"))), lambda x: x["body"]), "\n").alias("text"))
    stem = F.initcap(F.lower(F.trim(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))))
    documents = rows.join(texts, "document_id", "left").select(
        "document_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(stem, F.lit(""))).alias("document_name"), X.fingerprint(F.coalesce("text", F.lit("")), F.col("content")).alias("fingerprint"),
        F.lit(source).alias("source"), F.col("document_id").alias("source_identifier"), F.when(name != "", F.concat(F.lit("file://"), name)).alias("source_url"), F.lit("1.0").alias("version"), F.coalesce("n_sections", F.lit(0)).alias("n_sections"), "format", "error",
    )
    return documents, sections


def sections_to_items(sections: DataFrame) -> DataFrame:
    """One item for each section with text, with its concept."""
    rows = sections.where("error is null and body != ''")
    return rows.select(F.concat(F.lit("item_"), F.left(F.sha2(F.concat_ws(":", "document_id", F.col("order_index").cast("string")), 256), F.lit(12))).alias("content_id"), "document_id", F.col("title").alias("document_name"), F.col("heading").alias("section"), X.concept(F.col("heading")).alias("concept"), "loinc_code", F.col("body").alias("text"))


# Headings that segment a plain text.
STANDARD_SEGMENTS = (
    r"INDICATIONS\s+AND\s+USAGE", r"DOSAGE\s+AND\s+ADMINISTRATION", r"DOSAGE\s+FORMS\s+AND\s+STRENGTHS", "CONTRAINDICATIONS", r"WARNINGS\s+AND\s+PRECAUTIONS", r"ADVERSE\s+REACTIONS", r"DRUG\s+INTERACTIONS",
    r"USE\s+IN\s+SPECIFIC\s+POPULATIONS", "OVERDOSAGE", "DESCRIPTION", r"CLINICAL\s+PHARMACOLOGY", r"NONCLINICAL\s+TOXICOLOGY", r"CLINICAL\s+STUDIES", r"HOW\s+SUPPLIED/STORAGE\s+AND\s+HANDLING", r"PATIENT\s+COUNSELING\s+INFORMATION",
)
SEGMENT_LINE = r"(?im)^\s*(?:[0-9]+\s+)?(" + "|".join(STANDARD_SEGMENTS) + r")[:.]?\s*$"
SEGMENT_CHARS = 5000


def standard_segments(docs: DataFrame, document_id: str, text: str, chars: int | None = SEGMENT_CHARS) -> DataFrame:
    """(document_id, segment_no, section, text): texts cut at standard headings, on the JVM.

    A text without such a heading is one segment, "General Content"; blank segments are left out. chars of
    each are kept; None keeps all.
    """
    clean = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    rows = docs.select(F.col(document_id).alias("document_id"), clean.alias("t")).where("document_id is not null and t != ''")
    rows = rows.select("document_id", F.split("t", SEGMENT_LINE).alias("parts"), F.regexp_extract_all("t", F.lit(SEGMENT_LINE), F.lit(1)).alias("heads"))
    cut = F.zip_with("heads", F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), lambda h, p: F.struct(F.initcap(F.lower(h)).alias("section"), p.alias("text")))
    found = F.when(F.size("heads") == 0, F.array(F.struct(F.lit("General Content").alias("section"), F.element_at("parts", 1).alias("text")))).otherwise(cut)
    out = rows.select("document_id", F.posexplode(found).alias("segment_no", "s")).select("document_id", "segment_no", "s.section", F.regexp_replace("s.text", r"(?U)^\s+|\s+$", "").alias("text"))
    return out.where("text != ''").withColumn("text", _kept("text", chars))


def spl_items(files: DataFrame, document_id: str = "path", content: str = "content", least: int = 15, chars: int | None = ITEM_CHARS) -> DataFrame:
    """Items of structured product labels: sections with text of ``least`` characters or more, of which chars are kept (None: all)."""
    rows = parse_files(files.withColumn("_kind", F.lit("spl")), document_id, content, document_id, "_kind").where("error is null")
    return rows.where(F.length("body") >= least).select("document_id", F.col("title").alias("document_name"), F.col("heading").alias("section"), "loinc_code", _kept("body", chars).alias("text"))


def label_items(payloads: DataFrame, json_col: str, chars: int | None = ITEM_CHARS) -> DataFrame:
    """Items of openFDA-shaped payloads: one for each filled section of each result.

    Parsed by a fixed schema and unpivoted on the JVM. chars of each text are kept; None keeps all.
    """
    strings = T.ArrayType(T.StringType())
    openfda = T.StructType([T.StructField(n, strings) for n in ("brand_name", "generic_name", "application_number", "manufacturer_name", "route")])
    label = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "effective_time", "version")] + [T.StructField("openfda", openfda)] + [T.StructField(n, strings) for n in LABEL_SECTIONS])
    rows = payloads.select(F.explode(F.from_json(json_col, T.StructType([T.StructField("results", T.ArrayType(label))])).getField("results")).alias("r"))
    cells = F.array(*[F.struct(F.lit(title).alias("section"), F.trim(F.array_join(F.col(f"r.{key}"), " ")).alias("text")) for key, title in LABEL_SECTIONS.items()])
    first = lambda n: F.try_element_at(F.col(f"r.openfda.{n}"), F.lit(1))
    items = rows.select(F.col("r.id").alias("document_id"), F.col("r.version").alias("version"), F.col("r.effective_time").alias("publication_date"), first("brand_name").alias("product"), first("generic_name").alias("drug"), first("route").alias("route"), F.explode(cells).alias("s"))
    return items.where("s.text != ''").select("document_id", "version", "publication_date", "product", "drug", "route", "s.section", _kept("s.text", chars).alias("text"))
