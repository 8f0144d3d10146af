"""Queries on text functions: fingerprints, normal forms, tokens, headings, lists, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import read

# DuckDB's white space class is ASCII; hard blanks are made plain before it is used.
_PLAIN = "translate({0}, '" + X.SMART + "', '" + X.PLAIN.replace("'", "''") + "')"
_COLLAPSE = r"trim(regexp_replace({0}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_FINGERPRINT = "'fp_' || left(sha256(" + _COLLAPSE.format(r"regexp_replace(regexp_replace(translate(" + _PLAIN.format("{0}") + r", chr(65279), ''), '---\s*\[Page\s+\d+\]\s*---', '', 'g'), '\[Page\s+\d+\]', '', 'g')") + "), 16)"


def _fp(column: str) -> str:
    return _FINGERPRINT.replace("{0}", column)


_WORDS3 = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}'))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_CONSERVATIVE = "trim(" + _COLLAPSE.format(r"regexp_replace(lower(" + _PLAIN.format("{0}") + r"), '^\s*[-*•\d.)(]+\s+', '')") + ", ' .,;:!?-')"
_UNITS = "|".join(X.NUMBER_UNITS)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content fingerprint of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


def latest_per_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ingested document of each fingerprint, with the number of copies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "ingested_at", X.fingerprint(F.col("text")).alias("fingerprint"))
    # max_by over (time, id) combines map-side; a hot fingerprint is never one task's rows
    last = F.max(F.struct("ingested_at", "doc_id"))
    return docs.groupBy("fingerprint").agg(last.alias("x"), F.count("*").alias("n_copies")).select("fingerprint", "x.doc_id", "n_copies")


def conservative_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "content_items").select("content_id", X.conservative(F.col("text")).alias("norm")).distinct()


def aggressive_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "content_items").select("content_id", X.aggressive(F.col("text")).alias("norm")).distinct()


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "content_items").select("content_id", F.concat_ws("|", X.numeric_tokens(F.col("text"))).alias("numbers"))
    return items.where("numbers != ''").distinct()


def drug_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "content_items").groupBy("drug").agg(F.count("*").alias("n")).select("drug", "n", X.drug_token(F.col("drug")).alias("token"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the four token sets of every document."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(X.content_words(t)).alias("content_words"), F.size(X.words3(t)).alias("words3"), F.size(X.all_words(t)).alias("all_words"), F.size(F.array_distinct(X.blank_words(F.lower(t)))).alias("blank_words")
    )


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "chunks")
    return c.select("chunk_id", X.chunk_id(F.col("document_id"), F.col("section_id"), F.coalesce("chunk_type", F.lit("paragraph")), F.col("order_index"), F.col("content")).alias("derived_id")).distinct()


def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the document and section that they stand in."""
    doc = F.concat(F.lit("[Document: "), F.concat_ws(" | ", "document_name", "document_type", "jurisdiction"), F.lit("]"))
    sec = F.concat(F.lit("[Section: "), F.concat_ws(" > ", F.concat_ws(" ", "section_number", "section_title"), "exact_location"), F.lit("]"))
    return read(spark, sf_dir, "chunks").select("chunk_id", F.md5(F.concat_ws("\n", doc, sec, "content")).alias("context_md5")).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings among the lines of all documents."""
    found = _lines(spark, sf_dir).withColumn("h", X.heading(F.col("line"))).where("h is not null")
    return found.select("doc_id", "line_no", "h.*")


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading with its parent: the last heading before it of a lesser level."""
    found = headings(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # levels are 1 to 6 (deeper numbering counts as 6): one running maximum for each
    last = [F.max(F.when(F.least("level", F.lit(6)) == k, F.col("line_no"))).over(before) for k in range(1, 6)]
    parent = F.greatest(F.lit(-1), *[F.when(F.col("level") > k, F.coalesce(x, F.lit(-1))) for k, x in zip(range(1, 6), last)])
    return found.select("doc_id", "line_no", "title", "level", parent.alias("parent_line"))


def section_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "content_items").groupBy("section").agg(F.count("*").alias("n")).select("section", "n", X.concept(F.col("section")).alias("concept"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).withColumn("i", X.list_item(F.col("line"))).where("i is not null")
    return found.select("doc_id", "line_no", "i.*")


def embedding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length and nonzero dimensions of each document's hash embedding."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(X.blank_words(F.lower("text"))).alias("w"))
    dims = words.select("doc_id", X.embedding_dim(F.col("w")).alias("dim"), X.embedding_sign(F.col("w")).alias("s")).groupBy("doc_id", "dim").agg(F.sum("s").alias("x"))
    return dims.where("x != 0").groupBy("doc_id").agg(F.sum(F.col("x") * F.col("x")).alias("norm2"), F.count("*").alias("n_dims"))


def _case(column: str, rules: dict[str, str]) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '(?i)\\b({p})\\b') then '{n}'" for n, p in rules.items()) + " end"


def _heading_sql(source: str = "documents") -> str:
    number, mark = X.NUMBERED, X.MARKDOWN
    standard = ", ".join(f"'{h}'" for h in X.STANDARD_HEADINGS)
    return rf"""
    with lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {source})),
    clean as (select doc_id, line_no, regexp_replace(regexp_replace(line, '^[\s\x{{A0}}]+', ''), '[\s\x{{A0}}]+$', '') as c from lines),
    parts as (select *, rtrim(regexp_replace(c, ':+$', '')) as bare, regexp_extract(c, '{mark}', 1) as mk, regexp_extract(c, '{mark}', 2) as mt, regexp_extract(c, '{number}', 1) as num, regexp_extract(c, '{number}', 2) as nt from clean where c <> '' and length(c) <= 200),
    kinds as (select *, len(list_filter(regexp_split_to_array(bare, '\s+'), lambda w: w <> '')) as nw,
        regexp_extract(mt, '{number}', 1) as inum, regexp_extract(mt, '{number}', 2) as it from parts),
    named as (select doc_id, line_no, bare, nw, num, inum, case when mk <> '' then 'markdown' when num <> '' then 'numbered' when lower(bare) in ({standard}) then 'standard'
            when upper(bare) = bare and lower(bare) <> bare and nw between 1 and 10 and length(bare) <= 80 and (nw >= 2 or ({_case("bare", X.CONCEPTS)}) is not null) then 'uppercase' end as kind,
        trim(case when mk <> '' then case when inum <> '' then it else mt end when num <> '' then nt else bare end) as title, mk from kinds)
    select doc_id, line_no, kind, case kind when 'markdown' then nullif(inum, '') when 'numbered' then num end as section_number, title,
        case kind when 'markdown' then length(mk) when 'numbered' then len(string_split(num, '.')) else 1 end::int as level, {_case("title", X.CONCEPTS)} as concept
    from named where kind is not null"""


_ITEM_SQL = rf"""
    with lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
    clean as (select doc_id, line_no, regexp_replace(regexp_replace(line, '^[\s\x{{A0}}]+', ''), '[\s\x{{A0}}]+$', '') as c from lines),
    parts as (select doc_id, line_no, regexp_extract(c, '{X.BULLET}', 1) as b, regexp_extract(c, '{X.BULLET}', 2) as bt, regexp_extract(c, '{X.NUMBERED_ITEM}', 1) as i, regexp_extract(c, '{X.NUMBERED_ITEM}', 2) as o, regexp_extract(c, '{X.NUMBERED_ITEM}', 3) as nt from clean)
    select doc_id, line_no, case when b <> '' then 'bullet' when regexp_full_match(i || o, '[0-9]+') then 'numbered_item' when regexp_full_match(i || o, '[ivxcdmIVXCDM]+') then 'roman_item' else 'lettered_item' end as item_type,
        case when b <> '' then b when i <> '' then '(' || i || ')' else o || '.' end as marker, trim(case when b <> '' then bt else nt end) as content
    from parts where b <> '' or i <> '' or o <> ''"""

QUERIES = {
    "text_fingerprints": fingerprints,
    "latest_per_fingerprint": latest_per_fingerprint,
    "text_conservative": conservative_norms,
    "text_aggressive": aggressive_norms,
    "text_numeric_tokens": numeric_tokens,
    "text_drug_tokens": drug_tokens,
    "text_token_counts": token_counts,
    "text_chunk_ids": chunk_ids,
    "text_context": context_texts,
    "outline_headings": headings,
    "outline_tree": heading_tree,
    "outline_concepts": section_concepts,
    "outline_list_items": list_items,
    "embedding_sizes": embedding_sizes,
}
ORACLES = {
    "text_fingerprints": f"select doc_id, {_fp('text')} as fingerprint from documents",
    "latest_per_fingerprint": f"select fingerprint, arg_max(doc_id, (ingested_at, doc_id)) as doc_id, count(*) as n_copies from (select doc_id, ingested_at, {_fp('text')} as fingerprint from documents) group by 1",
    "text_conservative": f"select distinct content_id, {_CONSERVATIVE.replace('{0}', 'text')} as norm from content_items",
    "text_aggressive": "select distinct content_id, " + _COLLAPSE.format(r"regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]', ' ', 'g')") + " as norm from content_items",
    "text_numeric_tokens": rf"""select distinct content_id, numbers from (select content_id, array_to_string(list_sort(list_distinct(list_transform(
        regexp_extract_all(lower(text), '\b\d+(?:\.\d+)?(?:\s*(?:{_UNITS}))?\b'), lambda x: regexp_replace(x, '\s+', '', 'g')))), '|') as numbers from content_items) where numbers <> ''""",
    "text_drug_tokens": rf"""select drug, count(*) as n, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(drug, '')), '[^a-zA-Z0-9\s]', ' ', 'g'), '\b({"|".join(X.DRUG_NOISE)})\b', '', 'g'), '\s+', ' ', 'g')) as token from content_items group by drug""",
    "text_token_counts": f"""select doc_id, len(list_filter(w, lambda x: not list_contains({_STOPS}, x)))::int as content_words, len(w)::int as words3, len(a)::int as all_words, len(b)::int as blank_words from (
        select doc_id, list_distinct({_WORDS3.format('text')}) as w, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x <> '')) as a,
        list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{A0}}]+'), lambda x: x <> '')) as b from documents)""",
    "text_chunk_ids": "select distinct chunk_id, 'chk_' || left(sha256(concat_ws(':', document_id, section_id, coalesce(chunk_type, 'paragraph'), order_index::varchar, left(content, 64))), 12) as derived_id from chunks",
    "text_context": """select distinct chunk_id, md5(concat_ws(chr(10), '[Document: ' || concat_ws(' | ', document_name, document_type, jurisdiction) || ']',
        '[Section: ' || concat_ws(' > ', concat_ws(' ', section_number, section_title), exact_location) || ']', content)) as context_md5 from chunks""",
    "outline_headings": _heading_sql(),
    "outline_tree": f"""with h as ({_heading_sql()}), p as (select c.doc_id, c.line_no, max(b.line_no) as parent_line from h c join h b on b.doc_id = c.doc_id and b.line_no < c.line_no and least(b.level, 6) < c.level and b.level < 6 group by 1, 2)
        select h.doc_id, h.line_no, h.title, h.level, coalesce(p.parent_line, -1) as parent_line from h left join p using (doc_id, line_no)""",
    "outline_concepts": f"select section, count(*) as n, {_case('section', X.CONCEPTS)} as concept from content_items group by section",
    "outline_list_items": _ITEM_SQL,
    "embedding_sizes": r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\x{A0}]+'), lambda x: x <> '')) as w from documents),
        d as (select doc_id, ('0x' || right(md5(w), 2))::int as dim, sum(1 - 2 * (('0x' || substring(md5(w), 30, 1))::int % 2)) as x from w group by 1, 2)
        select doc_id, sum(x * x)::bigint as norm2, count(*) as n_dims from d where x <> 0 group by 1""",
}
