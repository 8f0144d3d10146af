"""Queries on search, merging, ledgers, measures and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import extract as K
from ..operators import compare as C
from ..operators import dedup, ledger, metrics, pipeline, search, store
from ..session import read, read_spread, stage
from .text_queries import _CONSERVATIVE, _STOPS, _WORDS3, _fp


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: evaluation cases whose id is divisible by 100."""
    return read(spark, sf_dir, "eval_cases").where("item_id % 100 = 0")


def lexical_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items for each query by lexical score."""
    # the drug stands last in the description
    drug = F.try_element_at(F.split("description", " "), F.lit(-1))
    queries = _asked(spark, sf_dir).select(F.col("item_id").alias("query_id"), drug.alias("query"), F.lit("Dosage and Administration").alias("section"), F.col("target_text"))
    return search.lexical_search(read(spark, sf_dir, "content_items"), queries)


def lexical_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical results of each query with duplicates merged greedily."""
    hits = lexical_top_k(spark, sf_dir)
    items = read(spark, sf_dir, "content_items").dropDuplicates(["content_id"])
    listed = hits.join(items, "content_id").select("query_id", "rank", *[c for c in dict.fromkeys([*dedup.PROVENANCE, "drug", "loinc_code", "text"])])
    merged = dedup.merge_greedily(listed, "query_id", "rank")
    return merged.select("query_id", "rank", "content_id", "cross_sources", "duplicate_ids")


def hash_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest documents of every evaluation case by hash-embedding cosine."""
    return search.cosine_top_k(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_cases"), "item_id", "target_text")


def hash_cosine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a threshold that leaves some cases without a hit; these get the first document."""
    docs, cases = read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_cases")
    hits = search.cosine_top_k(docs, "doc_id", "text", cases, "item_id", "target_text", threshold=0.6)
    return search.with_fallback(hits, cases, "item_id", "doc_id", docs.agg(F.min("doc_id")).first()[0])


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_vec"), "embedding", "label")


def dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query vector."""
    return search.cosine_top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector_queries(spark, sf_dir), "query_vec", "embedding", threshold=0.0)


def dense_top_k_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of the query's label."""
    return search.cosine_top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _vector_queries(spark, sf_dir), "query_vec", "embedding", threshold=0.0, match=("label", "label"))


def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, hit rate and reciprocal rank at 3 of each query vector; relevant is an equal label."""
    vectors, queries = read(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)
    hits = dense_top_k(spark, sf_dir)
    labelled = hits.join(queries.select("query_vec", F.col("label").alias("asked")), "query_vec").join(vectors.select("vec_id", "label"), "vec_id")
    sizes = queries.join(vectors.groupBy("label").agg(F.count("*").alias("n_relevant")), "label").select("query_vec", "n_relevant")
    return metrics.retrieval_metrics(labelled.select("query_vec", "rank", (F.col("asked") == F.col("label")).alias("is_relevant")), sizes, "query_vec", 3)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the false-match flag agrees with the expected mismatch of each evaluation pair."""
    from ..operators.compare import compare

    rows = compare(read(spark, sf_dir, "eval_cases")).select(metrics.outcome(F.col("expected_status") == "MISMATCH", F.col("false_match")).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each candidate text stands in its target text."""
    return read(spark, sf_dir, "eval_cases").select("item_id", metrics.grounded(F.col("candidate_text"), F.col("target_text")).alias("grounded"))


def phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the first sentence of an evaluation case."""
    phrases = read(spark, sf_dir, "eval_cases").select("item_id", F.substring_index("target_text", ". ", 1).alias("phrase"))
    return search.phrase_matches(read(spark, sf_dir, "documents"), "doc_id", "text", phrases, "item_id", "phrase")


def dedup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal statements with their provenance."""
    return dedup.exact_classes(read(spark, sf_dir, "content_items"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("change_id"), null.alias("decision_id"), F.lit(None).cast("map<string,string>").alias("details"), F.col("event_id").cast("string").alias("event_id"), "event_type", null.alias("new_state"),
        F.col("event_type").alias("new_status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), null.alias("previous_state"), null.alias("previous_status"), null.alias("report_id"), null.alias("reviewer_name"), F.col("event_id").alias("pos"),
    )


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain of every user's events."""
    return ledger.build_chain(_events(spark, sf_dir), "change_id", "pos").select("change_id", "seq", "event_id", "previous_event_hash", "event_hash")


def audit_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification of every chain."""
    # read twice, so built once
    return ledger.verify(stage(ledger.build_chain(_events(spark, sf_dir), "change_id", "pos"), "chain"), "change_id")


def audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification after every 50th event's type was changed."""
    chain = stage(ledger.build_chain(_events(spark, sf_dir), "change_id", "pos"), "chain")
    return ledger.verify(chain.withColumn("event_type", F.when(F.col("pos") % 50 == 0, "changed").otherwise(F.col("event_type"))), "change_id")


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals after upserts by key: the last delivery's status, the first one's creation."""
    p = read(spark, sf_dir, "proposals").where("change_id is not null")
    last = F.max(F.struct("updated_at", "status", F.md5("data").alias("data_md5")))
    return p.groupBy("change_id").agg(F.min("created_at").alias("created_at"), last.alias("x"), F.count("*").alias("n_deliveries")).select("change_id", "created_at", "x.*", "n_deliveries")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals as a keyed store holds them: the last delivery, with the creation that the first one told."""
    p = read(spark, sf_dir, "proposals").select("change_id", F.coalesce("updated_at", F.lit("")).alias("updated_at"), "status", F.md5("data").alias("data_md5"), F.coalesce("created_at", F.lit("")).alias("created_at"))
    return store.upsert(p, "change_id", "updated_at", keep_first=("created_at",))


def status_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest pending proposals."""
    p = read(spark, sf_dir, "proposals").where("status = 'PENDING_APPROVAL'").select("change_id", "updated_at").distinct()
    return store.latest(p, "updated_at", 20)


def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the chunk that they hang on."""
    c = read(spark, sf_dir, "chunks").select("chunk_id", "parent_chunk_id", "chunk_type").distinct()
    stems = c.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_type").alias("stem_type"))
    return c.where("parent_chunk_id is not null").join(stems, "parent_chunk_id", "left").select("chunk_id", "parent_chunk_id", "stem_type").distinct()


def orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results whose top document is unknown."""
    r = read(spark, sf_dir, "search_results").where("top_document_id is not null").select("search_id", "top_document_id").distinct()
    return r.join(read(spark, sf_dir, "provenance").select(F.col("document_id").alias("top_document_id")), "top_document_id", "left_anti").select("search_id", "top_document_id")


def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose document is not among the documents, by source."""
    items = read(spark, sf_dir, "content_items").where("document_id is not null").select("content_id", "document_id", "source").distinct()
    known = read(spark, sf_dir, "documents").select("document_id").where("document_id is not null")
    return items.join(known, "document_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def self_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each document has: items of its drug, without those that stand in no other document.

    Counted from sums by drug and by document, so no pairs of documents and items are made.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "document_id", X.drug_token(F.col("drug")).alias("token")).where("token != ''")
    items = read(spark, sf_dir, "content_items").where("content_id is not null").select("content_id", F.coalesce("document_id", F.lit("")).alias("document_id"), X.drug_token(F.col("drug")).alias("token"))
    places = items.groupBy("token", "content_id").agg(F.min("document_id").alias("first"), F.max("document_id").alias("last"))
    of_drug = places.groupBy("token").agg(F.count("*").alias("n_all"))
    own = places.where("first = last").groupBy("token", F.col("first").alias("document_id")).agg(F.count("*").alias("n_own"))
    rows = docs.join(of_drug, "token").join(own, ["token", "document_id"], "left")
    return rows.select("doc_id", (F.col("n_all") - F.coalesce("n_own", F.lit(0))).alias("n_candidates")).where("n_candidates > 0")


def jaccard_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that share most content words with each query case (ids divisible by 100)."""
    return search.jaccard_top_k(read(spark, sf_dir, "documents"), "doc_id", "text", _asked(spark, sf_dir), "item_id", "target_text")


def derived_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item would be searched by, and whether that looks like a section heading."""
    items = read(spark, sf_dir, "content_items")
    query = search.derived_query(F.col("drug"), F.col("indication"), F.col("section"), F.col("text"))
    return items.select("content_id", query.alias("query"), search.is_section_heading(query).alias("is_heading")).distinct()


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a store keeps: the latest of each id and fingerprint."""
    docs = read(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), "ingested_at", "source")
    return store.register(docs, "doc_id", "fingerprint", "ingested_at").select("doc_id", "fingerprint", "source")


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left in each source after the items of all documents seen in searches were removed."""
    seen = read(spark, sf_dir, "search_results").select("top_document_id")
    return store.remove(read(spark, sf_dir, "content_items"), "document_id", seen).groupBy("source").agg(F.count("*").alias("n"))


def adapted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate texts of all evaluation pairs with the target's dose and drug."""
    sides = read(spark, sf_dir, "eval_cases").select("item_id", "candidate_text", F.struct(*K.key_information(F.col("target_text"))).alias("a"), F.struct(*K.key_information(F.col("candidate_text"))).alias("b"))
    return sides.select("item_id", F.md5(C.adapted(F.col("candidate_text"), F.col("b.dose"), F.col("a.dose"), F.col("b.drug"), F.col("a.drug"))).alias("text_md5"))


def federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items as one bag of candidates by source, with the errors that searches met."""
    docs = read(spark, sf_dir, "documents").select(F.lower(F.trim("source")).alias("source"), F.lit("document").alias("kind"))
    items = read(spark, sf_dir, "content_items").select(F.lower(F.trim("source")).alias("source"), F.lit("item").alias("kind"), F.col("page"))
    errors = read(spark, sf_dir, "search_results").select(F.lower(F.trim("source")).alias("source"), F.lit("error").alias("kind"), F.explode("errors").alias("error"))
    both = docs.unionByName(items, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)
    return both.groupBy("source", "kind").agg(F.count("*").alias("n"), F.count("page").alias("n_paged"), F.count("error").alias("n_errors"))


def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delivery of a proposal affects: sections, documents and occurrences, from the nested records.

    Excluded occurrences never count. Once one was confirmed or excluded, only confirmed ones do; before
    that all do. The proposal's own section and document belong in, and its own text is one content more.
    """
    from ..operators import nested

    rows = nested.objects(read_spread(spark, sf_dir, "proposals", "change_id", "data").distinct(), "change_id", "data")
    one = lambda n: F.try_element_at(F.try_element_at("cells", F.lit(n)), F.lit(1))
    last = F.element_at(F.split("table_path", r"\."), -1)
    proposal, occurrence = one("section").isNotNull() & F.col("table_path").isin("", "payload.proposal"), last == "related_occurrences"
    seen = rows.where(proposal | occurrence).select("record_id", "delivery", occurrence.alias("is_occurrence"), F.coalesce(F.upper(F.trim(one("status"))), F.lit("PENDING")).alias("status"), one("section").alias("section"), one("document_name").alias("document_name"))
    deliveries = seen.groupBy("record_id", "delivery").agg(F.max(F.col("is_occurrence") & F.col("status").isin("CONFIRMED", "EXCLUDED")).alias("reviewed"), F.count_if("is_occurrence").alias("n_occurrences"), F.count_if(F.col("is_occurrence") & (F.col("status") == "CONFIRMED")).alias("n_confirmed"))
    counted = seen.join(deliveries, ["record_id", "delivery"])
    pending = F.col("is_occurrence") & F.col("reviewed") & ~F.col("status").isin("CONFIRMED", "EXCLUDED")
    affected = ~F.col("is_occurrence") | ((F.col("status") != "EXCLUDED") & (~F.col("reviewed") | (F.col("status") == "CONFIRMED")))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(affected, F.col(c)))), "|")
    return counted.groupBy("record_id", "delivery", "reviewed", "n_occurrences", "n_confirmed").agg(
        named("section").alias("sections"), named("document_name").alias("documents"), F.count_if(pending).alias("n_pending"),
    ).select(
        "record_id", F.col("delivery").cast("string").alias("delivery"), "reviewed", "n_occurrences", "n_confirmed", "n_pending", "sections", "documents",
        (F.lit(1) + F.when(F.col("reviewed"), F.col("n_confirmed")).otherwise(F.col("n_occurrences"))).alias("n_contents"),
    )


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated targets: evaluation cases whose id is divisible by 100, as passages of no document."""
    null = F.lit(None).cast("string")
    return _asked(spark, sf_dir).select(F.col("item_id").alias("target_id"), F.col("target_text").alias("text"), null.alias("section"), null.alias("document_id"), null.alias("fingerprint"), F.col("case_id").alias("content_id"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*dedup.PROVENANCE, "document_fingerprint", "loinc_code", "drug", "product", "indication", "text"]
    items = read_spread(spark, sf_dir, "content_items", *columns)
    return pipeline.retrieve(_targets(spark, sf_dir), items, read(spark, sf_dir, "documents").select("document_id", "drug"))


def retrieval_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every target: searched, merged, and the nearest kept."""
    return _retrieved(spark, sf_dir).select("target_id", "content_id", "similarity", "rank", "derived_type", "cross_sources", "duplicate_ids")


def compare_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates compared with their targets, best first."""
    rows = pipeline.compare_ranked(_targets(spark, sf_dir), _retrieved(spark, sf_dir))
    return rows.select("target_id", "place", "content_id", "similarity", "warning", "overall", F.array_join("matched_aspects", "|").alias("matched_aspects"), *[f"{d}_status" for d in C.DIMENSIONS])


def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all proposals: changes, sections they touch, confirmed and excluded occurrences."""
    from ..operators import nested

    rows = nested.objects(read_spread(spark, sf_dir, "proposals", "change_id", "data").distinct(), "change_id", "data")
    one = lambda n: F.try_element_at(F.try_element_at("cells", F.lit(n)), F.lit(1))
    occurrence = F.element_at(F.split("table_path", r"\."), -1) == "related_occurrences"
    status = F.when(occurrence, F.upper(F.trim(one("status"))))
    counted = F.when(~occurrence | (status == "CONFIRMED"), one("section"))
    seen = rows.where(occurrence | F.col("table_path").isin("", "payload.proposal"))
    return seen.agg(F.count_distinct("record_id").alias("n_changes"), F.count_distinct(counted).alias("n_sections"), F.count_if(status == "CONFIRMED").alias("n_confirmed"), F.count_if(status == "EXCLUDED").alias("n_excluded"))


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all chunk and item ids, and of all document ids written as items."""
    chunks, items = read(spark, sf_dir, "chunks"), read(spark, sf_dir, "content_items")
    ids = chunks.select("chunk_id").union(items.select("content_id")).union(items.select(F.concat("document_id", F.lit("_item"))))
    return store.documents_of(ids.toDF("id"), "id", chunks, items)


_SEARCH_SQL = f"""
    with asked as (select item_id as query_id, lower(string_split(description, ' ')[-1]) as query, 'dosage and administration' as section, lower(trim(target_text)) as target from eval_cases where item_id % 100 = 0),
    q as (select *, list_distinct({_WORDS3.format('query')}) as qw, list_distinct({_WORDS3.format('target')}) as tw from asked),
    i as (select *, lower(text) as low, list_distinct({_WORDS3.format('text')}) as w from content_items where text is not null),
    s as (select distinct query_id, content_id, (case when contains(low, query) then 4.0 else 0 end + case when contains(lower(drug), query) then 5.0 else 0 end + case when contains(lower(product), query) then 3.0 else 0 end + case when contains(lower(indication), query) then 3.0 else 0 end)::double
        + len(list_intersect(qw, w)) * 1.5::double + case when len(tw) > 0 then len(list_intersect(tw, w)) / (len(w) + len(tw) - len(list_intersect(tw, w))) * 3.0::double else 0 end
        + case when contains(coalesce(lower(i.section), ''), q.section) or contains(q.section, coalesce(lower(i.section), '')) or contains(coalesce(lower(i.subsection), ''), q.section) then 2.5::double else 0 end as score from q, i)
    select * from (select query_id, content_id, score, row_number() over (partition by query_id order by score desc, content_id)::int as rank from s where score > 0) where rank <= 10"""


def _cosine_sql(threshold: float) -> str:
    words = r"unnest(list_filter(regexp_split_to_array(lower({0}), '[\s\x{{A0}}]+'), lambda x: x <> ''))"
    unit = "select id, dim, x / sqrt(sum(x * x) over (partition by id)) as x from (select id, ('0x' || right(md5(w), 2))::int as dim, sum(1 - 2 * (('0x' || substring(md5(w), 30, 1))::int % 2))::double as x from {0} group by 1, 2) where x <> 0"
    return f"""with qw as (select item_id as id, {words.format('target_text')} as w from eval_cases), dw as (select doc_id as id, {words.format('text')} as w from documents),
        qv as ({unit.format('qw')}), dv as ({unit.format('dw')}), s as (select qv.id as item_id, dv.id as doc_id, least(1.0, sum(qv.x * dv.x)) as sim from qv join dv using (dim) group by 1, 2 having round(sum(qv.x * dv.x), 12) >= {threshold}),
        r as (select item_id, doc_id, round_even(round(sim, 12), 4) as similarity from s)
        select * from (select item_id, doc_id, similarity, row_number() over (partition by item_id order by similarity desc, doc_id)::int as rank from r) where rank <= 5"""


def _dense_sql(extra: str = "") -> str:
    return f"""with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select vec_id as query_vec, label as asked, e as qe from v where vec_id % 100 = 0),
        s as (select query_vec, vec_id, asked, label, round_even(round(greatest(0.0, least(1.0, list_dot_product(qe, e))), 12), 4) as similarity from q, v where list_dot_product(qe, e) >= -2 {extra})
        select * from (select query_vec, vec_id, similarity, row_number() over (partition by query_vec order by similarity desc, vec_id)::int as rank from s) where rank <= 5"""


_JSON = """'{"change_id":"' || change_id || '","decision_id":null,"details":{},"event_id":"' || event_id || '","event_type":"' || event_type || '","new_state":null,"new_status":"' || event_type || '","occurred_at":"' || occurred_at || '","previous_event_hash":"' || @prev || '","previous_state":null,"previous_status":null,"report_id":null,"reviewer_name":null}'"""
_CHAIN = f"""with recursive e as (select user_id::varchar as change_id, event_id::varchar as event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') as occurred_at, row_number() over (partition by user_id order by event_id) as seq from events),
    c as (select change_id, seq, event_id, null::varchar as previous_event_hash, sha256({_JSON.replace("@prev", "''")}) as event_hash from e where seq = 1
    union all select e.change_id, e.seq, e.event_id, c.event_hash, sha256({_JSON.replace('change_id ||', 'e.change_id ||').replace('|| event_id', '|| e.event_id').replace('@prev', 'c.event_hash')}) from c join e on e.change_id = c.change_id and e.seq = c.seq + 1)
    select change_id, seq, event_id, previous_event_hash, event_hash from c"""

QUERIES = {
    "search_lexical": lexical_top_k, "search_lexical_merged": lexical_merged, "search_hash_cosine": hash_cosine_top_k, "search_fallback": hash_cosine_fallback, "search_dense": dense_top_k, "search_dense_filtered": dense_top_k_filtered,
    "search_phrases": phrase_join, "search_self_excluded": self_excluded, "search_federated": federated, "metrics_retrieval": vector_metrics, "metrics_confusion": confusion, "metrics_grounded": groundedness, "dedup_classes": dedup_classes,
    "audit_chain": audit_chain, "audit_verified": audit_verified, "audit_tampered": audit_tampered, "table_upsert": latest_upsert, "table_upserted": upserted, "table_orphan_items": orphan_items, "table_status_scan": status_scan, "table_stems": stem_join, "table_orphans": orphan_results, "change_impact": change_impact, "impact_totals": impact_totals, "table_lookup": document_lookup, "retrieval_pipeline": retrieval_pipeline, "compare_ranked": compare_ranked,
    "search_jaccard": jaccard_top_k, "search_derived": derived_queries, "table_registered": registered, "table_removed": removed, "compare_adapted": adapted_texts,
}
ORACLES = {
    "search_lexical": _SEARCH_SQL,
    "search_hash_cosine": _cosine_sql(0.35),
    "search_fallback": f"with h as ({_cosine_sql(0.6)}) select * from h union all select distinct item_id, (select min(doc_id) from documents), 0.3, 1 from eval_cases where item_id not in (select item_id from h)",
    "search_dense": _dense_sql(),
    "search_dense_filtered": _dense_sql("and asked = label"),
    "search_phrases": r"""with p as (select item_id, trim(regexp_replace(lower(split_part(target_text, '. ', 1)), '[\s\x{A0}]+', ' ', 'g')) as p from eval_cases), d as (select doc_id, trim(regexp_replace(lower(text), '[\s\x{A0}]+', ' ', 'g')) as t from documents)
        select distinct item_id, doc_id from p, d where p <> '' and contains(t, p)""",
    "search_self_excluded": f"""with q as (select doc_id, document_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(drug, '')), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\b({"|".join(X.DRUG_NOISE)})\\b', '', 'g'), '\\s+', ' ', 'g')) as token from documents), i as (select content_id, document_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(drug, '')), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\b({"|".join(X.DRUG_NOISE)})\\b', '', 'g'), '\\s+', ' ', 'g')) as token from content_items)
        select doc_id, count(distinct content_id) as n_candidates from q join i using (token) where token <> '' and i.document_id is distinct from q.document_id group by 1""",
    "search_federated": """select source, kind, count(*) as n, count(page) as n_paged, count(error) as n_errors from (select lower(trim(source)) as source, 'document' as kind, null::int as page, null::varchar as error from documents
        union all select lower(trim(source)), 'item', page, null from content_items union all select lower(trim(source)), 'error', null, unnest(errors) from search_results) group by 1, 2""",
    "metrics_retrieval": f"""with h as ({_dense_sql()}), l as (select h.*, a.label = b.label as rel from h join embeddings a on a.vec_id = h.query_vec join embeddings b on b.vec_id = h.vec_id),
        s as (select a.vec_id as query_vec, count(*) as n_relevant from embeddings a join embeddings b using (label) where a.vec_id % 100 = 0 group by 1),
        m as (select query_vec, count(*) filter (rel and rank <= 3) as hits, min(rank) filter (rel) as first from l group by 1)
        select query_vec, round_even(coalesce(hits, 0) / n_relevant, 4) as recall, round_even(coalesce(hits, 0) / 3, 4) as precision, (coalesce(hits, 0) > 0)::int::double as hit_rate, coalesce(round_even(1.0::double / first, 4), 0) as reciprocal_rank from s left join m using (query_vec)""",
    "metrics_grounded": r"""select item_id, q <> '' and s <> '' and (contains(s, q) or contains(s, left(q, 50))) as grounded from (select item_id, trim(regexp_replace(lower(candidate_text), '[\s\x{A0}]+', ' ', 'g')) as q, trim(regexp_replace(lower(target_text), '[\s\x{A0}]+', ' ', 'g')) as s from eval_cases)""",
    "dedup_classes": f"""with r as (select content_id, source, document_id, {_CONSERVATIVE.replace('{0}', 'text')} as norm, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(drug, '')), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\b({"|".join(X.DRUG_NOISE)})\\b', '', 'g'), '\\s+', ' ', 'g')) as drug from content_items)
        select min(content_id) as first_id, drug, md5(norm) as text_md5, count(distinct content_id) as n_items, array_to_string(list_sort(list_distinct(list(source))), '|') as cross_sources, count(distinct document_id) as n_documents from r where norm <> '' group by drug, norm""",
    "audit_chain": _CHAIN,
    "audit_verified": "select user_id::varchar as change_id, true as valid, count(*) as n_events, null::varchar as first_bad_id, null::varchar as reason from events group by 1",
    "audit_tampered": """select user_id::varchar as change_id, count(*) filter (event_id % 50 = 0) = 0 as valid, count(*) as n_events, (min(event_id) filter (event_id % 50 = 0))::varchar as first_bad_id, case when count(*) filter (event_id % 50 = 0) > 0 then 'wrong hash' end as reason from events group by 1""",
    "table_upsert": """select change_id, min(created_at) as created_at, nullif(x.u, '') as updated_at, x.s as status, x.d as data_md5, n_deliveries from (
        select change_id, min(created_at) as created_at, max({u: coalesce(updated_at, ''), s: status, d: md5(data)}) as x, count(*) as n_deliveries from proposals where change_id is not null group by 1) group by all""",
    "table_upserted": """select change_id, x.u as updated_at, x.s as status, x.d as data_md5, f.c as created_at from (select change_id, max({u: coalesce(updated_at, ''), s: status, d: md5(data)}) as x,
        min({u: coalesce(updated_at, ''), c: coalesce(created_at, '')}) as f from proposals where change_id is not null group by 1)""",
    "table_orphan_items": "select source, count(*) as n from (select distinct content_id, document_id, source from content_items where document_id is not null and document_id not in (select document_id from documents where document_id is not null)) group by 1",
    "table_status_scan": "select distinct change_id, updated_at from proposals where status = 'PENDING_APPROVAL' order by updated_at desc, change_id limit 20",
    "table_stems": "select distinct c.chunk_id, c.parent_chunk_id, s.chunk_type as stem_type from chunks c left join chunks s on s.chunk_id = c.parent_chunk_id where c.parent_chunk_id is not null",
    "table_orphans": "select distinct search_id, top_document_id from search_results where top_document_id is not null and top_document_id not in (select document_id from provenance where document_id is not null)",
    "search_jaccard": f"""with q as (select item_id, list_filter(list_distinct({_WORDS3.format('target_text')}), lambda x: not list_contains({_STOPS}, x)) as qw from eval_cases where item_id % 100 = 0),
        d as (select doc_id, list_filter(list_distinct({_WORDS3.format('text')}), lambda x: not list_contains({_STOPS}, x)) as w from documents),
        s as (select item_id, doc_id, round_even(len(list_intersect(qw, w))::double / (len(qw) + len(w) - len(list_intersect(qw, w))), 4) as score from q, d)
        select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= 5""",
    "search_derived": rf"""with q as (select content_id, coalesce(nullif(trim(drug), ''), nullif(trim(indication), ''), nullif(trim(section), ''),
            nullif(array_to_string(list_filter(regexp_split_to_array(text, '[\s\x{{A0}}]+'), lambda w: length(w) > 3 and regexp_full_match(w, '\p{{L}}+'))[1:3], ' '), ''), nullif(trim(left(text, 40)), '')) as query from content_items)
        select distinct content_id, query, coalesce(regexp_matches(trim(query), '{search.HEADING_START}'), false) as is_heading from q""",
    "table_registered": f"""with d as (select doc_id, {_fp('text')} as fingerprint, ingested_at, source from documents)
        select doc_id, fingerprint, source from d qualify row_number() over (partition by fingerprint order by ingested_at desc, doc_id desc) = 1""",
    "table_lookup": """with c as (select chunk_id as content_id, min(document_id) as d from chunks group by 1), i as (select content_id, min(document_id) as d from content_items group by 1),
        a as (select distinct id from (select chunk_id as id from chunks union all select content_id from content_items union all select document_id || '_item' from content_items) where id is not null)
        select id as content_id, coalesce(c.d, i.d, case when ends_with(id, '_item') then left(id, length(id) - 5) end) as document_id,
            case when c.d is not null then 'chunk' when i.d is not null then 'item' when ends_with(id, '_item') then 'stem' end as found_by from a left join c on c.content_id = a.id left join i on i.content_id = a.id""",
    "table_removed": "select source, count(*) as n from content_items where document_id is null or document_id not in (select top_document_id from search_results where top_document_id is not null) group by 1",
}
