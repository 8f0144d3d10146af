"""From target passages to ranked, compared candidates: search, exclusion, merging, similarity, comparison.

Targets are a stated set; items are searched whole. Only the hits of each target (``fetch`` at most) are
enriched, merged and compared, so nothing but the search touches all items.

Defined results: targets without text have no candidates; a target's own document, fingerprint or item is
never its candidate; where no candidate is near enough the first one stands with a low fixed similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract as K
from ..session import broadcast_if_small, stage
from . import compare as C
from . import dedup, search

#: What a target has.
TARGET = ("target_id", "text", "section", "document_id", "fingerprint", "content_id")


def verified_drug(targets: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(target_id, drug): the drug that a target names, else its document's, else that of its document's first item; never a heading."""
    named = lambda c: F.when((F.trim(c) != "") & ~search.is_section_heading(c), F.trim(c))
    asked = targets.select("target_id", "document_id", named(F.struct(*K.key_information(F.col("text")))["drug"]).alias("own"))
    ids = broadcast_if_small(stage(asked.where("own is null and document_id is not null").select("document_id").distinct(), "asked"))
    of_documents = documents.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.min(named(F.col("drug"))).alias("of_document"))
    of_items = items.join(ids, "document_id", "left_semi").where(named(F.col("drug")).isNotNull()).groupBy("document_id").agg(F.min_by(named(F.col("drug")), "content_id").alias("of_item"))
    rows = asked.join(of_documents, "document_id", "left").join(of_items, "document_id", "left")
    return rows.select("target_id", F.coalesce("own", "of_document", "of_item").alias("drug"))


def from_sources(items: DataFrame, sources: tuple[str, ...] | None) -> DataFrame:
    """Items of these sources, without case and outer blanks; None or "all" keeps every one."""
    if sources is None or "all" in sources:
        return items
    return items.where(F.lower(F.trim("source")).isin(*[s.lower().strip() for s in sources]))


def _similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the cosine of the hash embeddings of two text columns, rounded to 4 digits."""
    fields = pairs.schema.fields
    names = [*[f.name for f in fields], "similarity"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (search.embed(batch.column(batch.schema.get_field_index(c)).to_pylist(), {}) for c in (a, b))
            near = np.round(np.clip((x * y).sum(axis=1), 0.0, 1.0), 12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pairs.mapInArrow(run, f"{schema}, similarity double").withColumn("similarity", F.bround("similarity", 4))


def retrieve(targets: DataFrame, items: DataFrame, documents: DataFrame, k: int = search.TOP_K, threshold: float = search.THRESHOLD, sources: tuple[str, ...] | None = None, fetch: int | None = None) -> DataFrame:
    """(target_id, content_id, similarity, rank, derived_type, cross_sources, duplicate_ids) and the items' columns of the k best candidates.

    targets has the columns TARGET. Items are searched by the verified drug, else what else the target
    tells; the fetch best (twice k, 10 at least) are merged and ranked by similarity.
    """
    fetch = fetch or max(2 * k, 10)
    given = targets.where("target_id is not null and text is not null")
    facts = F.struct(*K.key_information(F.col("text")))
    drugs = verified_drug(given, documents, items)
    asked = given.withColumn("k", facts).join(drugs, "target_id").select(*TARGET, "drug", search.derived_query(F.col("k.drug"), F.col("k.indication"), F.col("section"), F.col("text")).alias("derived"))
    queries = stage(asked.select(F.col("target_id").alias("query_id"), F.coalesce("drug", "derived").alias("query"), "section", F.col("text").alias("target_text"), "document_id", "fingerprint", "content_id"), "queries")
    pool = from_sources(items, sources)
    hits = stage(search.lexical_search(pool, queries, k=fetch, exclude=True), "hits")
    # one row of each item that was hit
    wanted = broadcast_if_small(hits.select("content_id").distinct())
    found = pool.join(wanted, "content_id", "left_semi").dropDuplicates(["content_id"])
    listed = hits.withColumnRenamed("rank", "found_at").drop("score").join(found, "content_id").withColumn("derived_type", K.content_type(F.col("text"), F.col("section")))
    merged = dedup.merge_greedily(listed, "query_id", "found_at")
    both = merged.join(broadcast_if_small(queries.select("query_id", "target_text")), "query_id")
    near = stage(_similarity(both, "target_text", "text"), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "content_id")
    top = near.where(F.col("similarity") >= threshold).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = Window.partitionBy("query_id").orderBy("found_at")
    missed = near.join(broadcast_if_small(top.select("query_id").distinct()), "query_id", "left_anti").withColumn("rank", F.row_number().over(first)).where("rank = 1").withColumn("similarity", F.lit(search.FALLBACK_SCORE))
    return top.unionByName(missed).withColumnRenamed("query_id", "target_id").drop("found_at", "target_text")


def compare_ranked(targets: DataFrame, candidates: DataFrame, tier: Column | None = None) -> DataFrame:
    """The candidates of ``retrieve`` compared with their targets and ranked: without a warning first, then by tier, then by similarity.

    tier: a number for each row that an application may rank by before similarity.
    """
    sides = candidates.withColumnRenamed("text", "candidate_text").withColumnRenamed("section", "candidate_section").drop("rank")
    pairs = sides.join(broadcast_if_small(targets.select("target_id", F.col("text").alias("target_text"), F.col("section").alias("target_section"))), "target_id")
    rows = C.compare(pairs, target_section="target_section", candidate_section="candidate_section", candidate_type="derived_type")
    rows = rows.withColumn("warning", C.warning(F.col("false_match_reasons"))).withColumn("matched_aspects", C.matched_aspects(F.col("target_text"), F.col("candidate_text")))
    rows = rows.withColumn("overall", C.overall(F.col("warning"))).withColumn("tier", tier if tier is not None else F.lit(0))
    order = Window.partitionBy("target_id").orderBy(F.col("warning").isNull().desc(), F.desc("tier"), F.desc("similarity"), "content_id")
    return rows.withColumn("place", F.row_number().over(order))
