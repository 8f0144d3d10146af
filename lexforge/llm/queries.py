"""Queries of the training-data problems tagged llm (3, 4, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read, read_spread
from . import language, leakage, mixing, neardup, splitting


def _pieces(spark: SparkSession, sf_dir: str, keep_whole: bool) -> DataFrame:
    limits = read(spark, sf_dir, "split_limits")
    chunks = splitting.split_oversized(read(spark, sf_dir, "chunks"), "chunk_id", "content", limits, "chunk_type", keep_whole=keep_whole)
    items = splitting.split_oversized(read(spark, sf_dir, "content_items"), "content_id", "text", limits, F.lit("content_item"), keep_whole=keep_whole)
    return chunks.unionByName(items)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of chunks and content_items that had to be cut: those with a second piece."""
    return _pieces(spark, sf_dir, keep_whole=False).where("piece_no = 1").select("record_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all records."""
    return _pieces(spark, sf_dir, keep_whole=True)


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.link_classes(neardup.fingerprints(read_spread(spark, sf_dir, "content_items", "content_id", "text", "drug"), "content_id", "text", "drug"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items that say the same about the same drug."""
    return neardup.linked_pairs(*_statements(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its class of equal statements and the number of other classes linked to it."""
    members, links = _statements(spark, sf_dir)
    both = links.select(F.explode(F.array("class_id_a", "class_id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(both, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between classes of equal statements, each once; p4_classes has the members."""
    return _statements(spark, sf_dir)[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage of an evaluation case."""
    return leakage.find_leaks(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", read(spark, sf_dir, "eval_cases"), "item_id", ["target_text", "candidate_text"], by_edits=True)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_spread(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source", read(spark, sf_dir, "mix_targets"))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of all sources."""
    return _mixed(spark, sf_dir)[1]


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(read_spread(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", language.train(docs, "doc_id", "text", "lang"), ("lang",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong or that mix languages."""
    return language.mislabelled(_identified(spark, sf_dir), "doc_id", "lang")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, confidence and number of segments."""
    return _identified(spark, sf_dir).select("doc_id", "lang", "language", "confidence", F.size("segments").alias("n_segments"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's place, language, confidence and full sentences."""
    return _identified(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_classes": p4_classes, "p4_links": p4_links, "p6_found": p6_found, "p7_uses": p7_uses, "p7_shares": p7_shares, "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}

_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sql_neighbours() -> str:
    """Every two texts of equal drug and numbers compared word set by word set."""
    salts = "[" + ", ".join(f"'{w}'" for w in sorted(neardup.SALTS_AND_FORMS)) + "]"
    parts = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
    key = lambda x: f"coalesce(nullif(array_to_string(list_filter({parts(x)}, lambda z: not list_contains({salts}, z)), ''), ''), nullif(array_to_string({parts(x)}, ''), ''))"
    plain = "case when regexp_full_match(n, '\\d{1,3}(,\\d{3})+(\\.\\d+)?') then replace(n, ',', '') else replace(n, ',', '.') end"
    bare = f"list_transform(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda n: {plain}), lambda n: case when len(n) - len(replace(n, '.', '')) = 1 then rtrim(rtrim(n, '0'), '.') else n end)"
    return f"""
        with r as (select distinct content_id as id, text, drug, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') as raw from content_items where content_id is not null and text is not null and length(text) <= 2000),
        p as (select id, text, raw, {key("drug")} as drug, list_sort(list_distinct(list_transform({bare}, lambda n: case when ltrim(n, '0') = '' then '0' else ltrim(n, '0') end))) as numbers,
            list_distinct(list_filter(list_transform(raw, lambda x: regexp_replace(regexp_replace(x, '^\\p{{P}}+', ''), '\\p{{P}}+$', '')), lambda x: x <> '')) as words from r),
        known as (select distinct drug from p where drug is not null and len(words) > 0),
        o as (select id, text, list_filter(list_transform(raw, lambda x, i: {{'pos': i, 'k': {key("x")}}}), lambda x: x.k is not null) as l from p where drug is null),
        q as (select id, text, unnest([l, list_filter(l, lambda x: not list_contains({salts}, x.k))]) as l from o),
        m as (select id, text, l[s].pos as pos, array_to_string(list_transform(l[s:s + n - 1], lambda x: x.k), '') as drug from (select *, unnest(range(1, len(l) + 1)) as s from q), (select unnest(range(1, 7)) as n) where s + n - 1 <= len(l)),
        f as (select id, text, drug from m join known using (drug) qualify row_number() over (partition by id, text order by pos, length(drug) desc, drug) = 1),
        t as (select id, coalesce(p.drug, f.drug) as drug, numbers, words from p left join f using (id, text) where len(words) > 0)
        select distinct a.id as content_id_a, b.id as content_id_b from t a join t b on a.drug = b.drug and a.numbers = b.numbers and a.id < b.id
        where 5 * len(list_intersect(a.words, b.words)) >= 4 * len(list_distinct(a.words || b.words))"""


ORACLES = {
    "p4_found": _sql_neighbours(),
    "p3_found": """
        select distinct record_id from (
            select chunk_id as record_id, content as t, coalesce(nullif(lower(trim(chunk_type)), ''), 'paragraph') as kind from chunks
            union all select content_id, text, 'content_item' from content_items) r
        join split_limits l on l.record_kind = r.kind where length(t) > max_chars and record_id is not null""",
}
