"""Queries on parsing, sections and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapt, chunking, occurrences
from ..session import read, read_spread, shared_folder
from ..sources import formats, ingest
from ..streaming import jobs
from .text_queries import _heading_sql


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document with their parents."""
    return chunking.sections(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document."""
    return chunking.chunk_documents(read_spread(spark, sf_dir, "documents", "doc_id", "text", "document_name"), "doc_id", "text", "document_name")


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_spans(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the pipe, HTML and TSV tables in all documents."""
    return chunking.table_rows(read(spark, sf_dir, "documents"), "doc_id", "text")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as label payloads: a source for the parsers with a known content."""
    items = read(spark, sf_dir, "content_items").where("text is not null").select("content_id", F.coalesce("drug", F.lit("none")).alias("drug"), "text").distinct()
    body = F.struct(F.col("content_id").alias("id"), F.lit("1").alias("version"), F.struct(F.array("drug").alias("generic_name")).alias("openfda"), F.array("text").alias("indications_and_usage"), F.array(F.lit("")).alias("warnings"))
    return items.select("content_id", F.to_json(F.struct(F.array(body).alias("results"))).alias("payload"))


def label_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of label payloads, one for each filled section."""
    return ingest.label_items(_labels(spark, sf_dir), "payload").select("document_id", "drug", "section", F.md5("text").alias("text_md5"))


def label_unpivot_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole texts; the other keeps the reference's cut."""
    return ingest.label_items(_labels(spark, sf_dir), "payload", chars=None).select("document_id", "drug", "section", F.md5("text").alias("text_md5"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_KINDS = ("html", "xml", "json", "md")


def _as(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Items as files of these formats, each with a title, one section and the text on one line."""
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    items = read_spread(spark, sf_dir, "content_items", "content_id", "text").where("text is not null").select("content_id", flat.alias("t")).distinct()
    t = F.col("t")
    wrapped = {
        "html": F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=utf-8><title>Label</title><style>p{}</style></head><body><nav>Menu</nav><h2>Overdosage</h2><p>"), _escaped(t), F.lit("</p></body></html>")),
        "xml": F.concat(F.lit('<document xmlns="urn:hl7-org:v3"><title>Label</title><component><structuredBody><component><section><code code="34088-5" displayName="OVERDOSAGE"/><title>Overdosage</title><text><paragraph>'), _escaped(t), F.lit("</paragraph></text></section></component></structuredBody></component></document>")),
        "json": F.to_json(F.struct(F.lit("Label").alias("title"), F.array(F.struct(F.lit("Overdosage").alias("heading"), t.alias("content"))).alias("sections"))),
        "md": F.concat(F.lit("# Label\n\n## Overdosage\n\n"), t),
    }
    files = F.array(*[F.struct(F.lit(k).alias("written"), F.encode(wrapped[k], "UTF-8").alias("content")) for k in kinds])
    return items.select("content_id", F.explode(files).alias("f")).select("content_id", "f.content", F.concat("content_id", F.lit("."), "f.written").alias("path"), "f.written")


def parsed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' texts written as HTML, XML, JSON and Markdown files, and parsed back."""
    both = ingest.parse_files(_as(spark, sf_dir, *_KINDS), "content_id")
    return both.where("heading = 'Overdosage'").select("document_id", "format", "loinc_code", F.md5("body").alias("body_md5"))


def resolved_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats that names and first bytes give for the same files, and how many agree."""
    both = _as(spark, sf_dir, *_KINDS).select("written", formats.resolve(F.col("path"), F.col("content")).alias("by_name"), formats.resolve(F.lit(None).cast("string"), F.col("content")).alias("by_bytes"))
    return both.groupBy("written", "by_name", "by_bytes").agg(F.count("*").alias("n"))


def chunk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as items: pages and table places resolved."""
    items = adapt.chunks_to_items(read(spark, sf_dir, "chunks"), with_facts=False)
    return items.select("content_id", "page", F.col("metadata")["table_title"].alias("table_title"), F.col("metadata")["row_index"].alias("row_index"), F.size("metadata").alias("n_meta")).distinct()


def item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items put together again as the sections of their documents, ten pages a part."""
    items = read(spark, sf_dir, "content_items").select("content_id", "document_id", "section", "text", F.coalesce("page", F.lit(0)).alias("o"))
    return adapt.items_to_sections(items, "o", F.floor(F.col("o") / 10).cast("int")).select("document_id", "section", "part", "position", F.md5("text").alias("text_md5"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every document by what it has: chunks, else sections, else text."""
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "document_id", "document_name", "source", "source_identifier", "drug", "text")
    chunks = read(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    # a section is known by its row, its items by the document that it belongs to
    sections = chunking.sections(docs, "doc_id", "text").withColumnRenamed("document_id", "doc")
    named = sections.join(docs.select(F.col("doc_id").cast("string").alias("doc"), "document_id"), "doc").drop("doc")
    items = adapt.documents_to_items(docs, chunks, named)
    return items.select("content_id", "document_id", "branch", "content_type", "section", "exact_location", F.md5("text").alias("text_md5"))


def item_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as chunks: ids, types and paths that they tell or that are built for them."""
    items = read(spark, sf_dir, "content_items").drop("metadata")
    return adapt.items_to_chunks(items).select("chunk_id", "document_id", "section_id", "chunk_type", "structure_path", F.md5("content").alias("content_md5")).distinct()


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested from files: the items' texts as Markdown."""
    return ingest.ingest(_as(spark, sf_dir, "md"), document_id="content_id")[0].select("document_id", "document_name", "fingerprint", "source_url", "n_sections", "format")


def _occurrences(spark: SparkSession, sf_dir: str, scores: bool) -> DataFrame:
    phrases = read(spark, sf_dir, "eval_cases").where("item_id % 100 = 0").select("item_id", F.substring_index("target_text", ". ", 1).alias("phrase"))
    sections = chunking.sections(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return occurrences.find_occurrences(sections, "section_id", "heading", "body", phrases, "item_id", "phrase", document="document_id", order="order_index", scores=scores)


def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences in the sections of all documents of the stated phrases: first sentences of the evaluation cases with an id divisible by 100."""
    return _occurrences(spark, sf_dir, scores=False)


def occurrence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same occurrences with what their comparison with the phrase says in each dimension."""
    return _occurrences(spark, sf_dir, scores=True).select("phrase_id", "row_id", "layer", F.explode("scores").alias("dimension", "score"), "false_match")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the event stream, read as a stream to its end and written batch by batch."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.start_windows(stream, "ts", "event_type", f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.windows(spark, f"{base}/out", "event_type").select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


def standard_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at standard headings."""
    return ingest.standard_segments(read(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", "segment_no", "section", F.md5("text").alias("text_md5"))


def standard_segments_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole texts; the other keeps the reference's cut."""
    return ingest.standard_segments(read(spark, sf_dir, "documents"), "doc_id", "text", chars=None).select("document_id", "segment_no", "section", F.md5("text").alias("text_md5"))


_FLAT = r"trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g'))"
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{A0}}]+', ''), '[\s\x{{A0}}]+$', '')"
_SECTIONS_SQL = rf"""
    with docs as (select doc_id, {_STRIP.format("text")} as text from documents), heads as ({_heading_sql("docs")}),
    lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from docs where text <> '')),
    marked as (select l.doc_id, l.line_no, l.line, h.level, h.section_number, h.concept, h.line_no is not null as is_head, sum((h.line_no is not null)::int) over (partition by l.doc_id order by l.line_no) as sec from lines l left join heads h on h.doc_id = l.doc_id and h.line_no = l.line_no),
    grouped as (select doc_id, sec, coalesce(max(level), 1) as level, max(section_number) as section_number, max(concept) as concept, coalesce(max({_STRIP.format("line")}) filter (is_head), 'General Content') as heading,
        {_STRIP.format("coalesce(string_agg(line, chr(10) order by line_no) filter (not is_head), '')")} as body from marked group by 1, 2),
    numbered as (select *, (row_number() over (partition by doc_id order by sec) - 1)::int as order_index from grouped),
    named as (select *, 'sec_' || doc_id || '_' || order_index || '_' || left(regexp_replace(lower(coalesce(section_number, heading)), '[^a-zA-Z0-9]', '_', 'g'), 20) as section_id from numbered),
    parents as (select c.doc_id, c.order_index, arg_max(p.section_id, p.order_index) as parent_section_id from named c join named p on p.doc_id = c.doc_id and p.order_index < c.order_index and p.level < c.level group by 1, 2)
    select n.doc_id::varchar as document_id, section_id, parent_section_id, n.order_index, level, section_number, heading, concept, body from named n left join parents p on p.doc_id = n.doc_id and p.order_index = n.order_index"""
QUERIES = {"document_items": document_items, "adapt_item_chunks": item_chunks, "source_ingested": ingested, "document_sections": document_sections, "document_chunks": document_chunks, "document_sentences": document_sentences, "document_tables": document_tables, "source_label_unpivot": label_unpivot, "source_parsed_formats": parsed_formats, "source_resolved_formats": resolved_formats, "adapt_chunk_items": chunk_items, "adapt_item_sections": item_sections, "occurrence_layers": phrase_occurrences, "occurrence_scores": occurrence_scores, "stream_windows": stream_windows, "source_standard_segments": standard_segments, "source_label_unpivot_whole": label_unpivot_whole, "source_standard_segments_whole": standard_segments_whole}
_RULE_SQL = r"'^\s*\|?(\s*:?-+:?\s*\|)+\s*(:?-+:?)?\s*\|?\s*$'"
_CELLS_SQL = r"list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\|+', ''), '\|+$', ''), '|'), lambda x: trim(x))"
_TABLES_SQL = f"""
    with l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null)),
    m as (select *, contains(line, '|') as p, coalesce(lead(regexp_matches(trim(line), {_RULE_SQL})) over (partition by doc_id order by i), false) as ruled from l),
    g as (select *, max(case when p and ruled then i end) over (partition by doc_id order by i) as head, sum((not p or starts_with(trim(line), '#'))::int) over (partition by doc_id order by i) as breaks from m),
    d as (select g.doc_id, g.head, g.i - g.head - 2 as row_no, {_CELLS_SQL.replace('line', 'g.line')} as c, {_CELLS_SQL.replace('line', 'h.line')} as names from g join g h on h.doc_id = g.doc_id and h.i = g.head join g r on r.doc_id = g.doc_id and r.i = g.head + 1
        where g.i >= g.head + 2 and g.breaks = r.breaks),
    k as (select doc_id, (dense_rank() over (partition by doc_id order by head) - 1)::int as table_no, row_no::int as row_no, case when len(names) > 1 then list_filter(names, lambda x: x <> '') else names end as names, c from d)
    select doc_id::varchar as document_id, table_no, row_no, names[n] as header, coalesce(c[n], '') as value from (select *, unnest(range(1, len(names) + 1)) as n from k)"""
ORACLES = {
    "document_tables": _TABLES_SQL,
    "adapt_item_chunks": """select distinct content_id as chunk_id, coalesce(document_id, 'doc_' || content_id) as document_id, 'sec_' || content_id as section_id, coalesce(content_type, 'paragraph') as chunk_type,
        coalesce(nullif(concat_ws(' > ', nullif(document_name, ''), case when section is not null then trim(concat_ws(' ', subsection, section)) end, case when exact_location is distinct from section then exact_location end), ''), section, 'Document') as structure_path,
        md5(text) as content_md5 from content_items where content_id is not null""",
    "document_sections": _SECTIONS_SQL,
    "source_label_unpivot": "select distinct content_id as document_id, coalesce(drug, 'none') as drug, 'Indications and Usage' as section, md5(left(trim(text), 4000)) as text_md5 from content_items where trim(text) <> ''",
    "source_parsed_formats": f"select content_id as document_id, f as format, case f when 'xml' then '34088-5' end as loinc_code, md5(t) as body_md5 from (select distinct content_id, {_FLAT} as t from content_items where text is not null), (select unnest(['html', 'xml', 'json', 'md']) as f)",
    "source_resolved_formats": f"select f as written, f as by_name, f as by_bytes, count(*) as n from (select distinct content_id, {_FLAT} as t from content_items where text is not null), (select unnest(['html', 'xml', 'json', 'md']) as f) group by 1",
    "adapt_chunk_items": r"""with c as (select *, coalesce(chunk_type = 'table_row' or contains(lower(exact_location), 'table'), false) as tab from chunks),
        m as (select *, case when tab then coalesce(nullif(trim(regexp_extract(exact_location, '(?i)^(.*?),\s*Row\s+(\d+)', 1)), ''), list_filter(list_transform(string_split(structure_path, '>'), lambda p: trim(p)), lambda p: regexp_matches(p, '(?i)^table\b'))[1]) end as table_title,
            case when tab then nullif(regexp_extract(exact_location, '(?i)^(.*?),\s*Row\s+(\d+)', 2), '') end as row_index from c)
        select distinct chunk_id as content_id, coalesce(page, try_cast(nullif(regexp_extract(exact_location, '(?i)(?:Pages?|p\.)\s*(\d+)', 1), '') as int), try_cast(nullif(regexp_extract(trim(content), '(?i)^\[Page\s+(\d+)\]', 1), '') as int)) as page, table_title, row_index,
            len(list_filter([parent_chunk_id, section_id, structure_path, order_index::varchar, jurisdiction, document_type, normalized_section, table_title, row_index], lambda x: x is not null))::int as n_meta from m""",
    "adapt_item_sections": "select document_id, section, (o // 10)::int as part, min(o) as position, md5(string_agg(text, chr(10) || chr(10) order by o, content_id, text)) as text_md5 from (select content_id, document_id, coalesce(section, 'General Content') as section, text, coalesce(page, 0) as o from content_items) where document_id is not null and text is not null group by 1, 2, 3",
    "stream_windows": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "source_standard_segments": f"""with d as (select doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '') as t from documents),
        p as (select doc_id, regexp_split_to_array(t, '{ingest.SEGMENT_LINE}') as parts, regexp_extract_all(t, '{ingest.SEGMENT_LINE}', 1) as heads from d where t <> ''),
        s as (select doc_id, unnest(case when len(heads) = 0 then [0] else range(len(heads)) end) as segment_no, heads, parts from p),
        x as (select doc_id, segment_no, case when len(heads) = 0 then 'General Content' else array_to_string(list_transform(string_split(lower(heads[segment_no + 1]), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as section,
            regexp_replace(regexp_replace(case when len(heads) = 0 then parts[1] else parts[segment_no + 2] end, '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '') as t from s)
        select doc_id as document_id, segment_no, section, md5(left(t, {ingest.SEGMENT_CHARS})) as text_md5 from x where t <> ''""",
}
