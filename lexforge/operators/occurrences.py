"""Related occurrences of a phrase in sections: four layers, the first that holds.

exact (the phrase stands in the text), normalized (its normal form does), structured (same drug and same
dose or route), semantic (hash-embedding cosine). Texts that name another drug are no occurrences.

Phrases are a stated set and travel to the rows in blocks. Facts are read only from texts that may match.

Defined results: null texts, texts under 5 and phrases under 3 characters have none; equal beginnings of
``snippet`` characters (None: equal texts) within one section of one document count once, by the first of
them in ``order``. Without a document column every row is a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as K
from ..functions import text as X
from ..session import broadcast_if_small, stage
from . import compare as C
from . import search

SEMANTIC = 0.55
# Fixed value: characters of a text by which occurrences within one section are told apart.
SNIPPET = 60


def find_occurrences(rows: DataFrame, row_id: str, section: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, threshold: float = SEMANTIC, document: str | None = None, order: str | None = None, snippet: int | None = SNIPPET, scores: bool = False) -> DataFrame:
    """(phrase_id, row_id, section, layer, relevance, similarity) of every occurrence.

    document names the column within which equal beginnings count once, order the one that ranks its rows.
    scores adds each dimension's status and score, of the phrase compared with the occurrence in its section.
    """
    whole = lambda p: _find(rows, row_id, section, text, p, phrase_id, phrase, threshold, document, order, snippet, scores)
    # phrases become part of the plan, so blocks are small
    return search.in_blocks(phrases, phrase_id, whole, 500)


def _find(rows: DataFrame, row_id: str, section: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, threshold: float, document: str | None, order: str | None, snippet: int | None, scores: bool) -> DataFrame:
    held = search.collect_queries(phrases.select(phrase_id, phrase).where(F.length(F.trim(phrase)) >= 3))
    facts = ("drug", "dose", "route")
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(r[0]), r[1].strip()) for r in held], "phrase_id long, p string").select("phrase_id", "p", X.conservative(F.col("p")).alias("norm"), *K.key_information(F.col("p")))
    asked = table.collect()  # as many rows as phrases
    sections = rows.where(F.col(row_id).isNotNull() & (F.length(F.trim(F.col(text))) >= 5)).select(F.col(row_id).alias("row_id"), F.coalesce(section, F.lit("Unspecified Section")).alias("section"), F.col(text).alias("t"), F.col(document or row_id).alias("document"), F.col(order or row_id).alias("o"))
    if not asked:
        none = sections.select(F.lit(None).cast("long").alias("phrase_id"), "row_id", "section", F.lit(None).cast("string").alias("layer"), F.lit(None).cast("string").alias("relevance"), F.lit(None).cast("double").alias("similarity")).limit(0)
        return none if not scores else none.select("*", F.create_map().cast("map<string,string>").alias("statuses"), F.create_map().cast("map<string,double>").alias("scores"), F.lit(False).alias("false_match"))
    # read several times, and costly to make
    sections = stage(sections.withColumn("h", F.xxhash64("t")), "sections")
    block = F.array(*[F.struct(F.lit(r["phrase_id"]).alias("id"), F.lit(r["p"]).alias("p"), F.lit(r["norm"]).alias("norm"), *[F.lit(r[f]).cast("string").alias(f) for f in facts]) for r in asked])
    low = lambda c: F.lower(F.trim(c))
    # whatever names the phrase's drug may match by its facts; the rest must hold the phrase or be near it
    may = lambda q: F.contains(F.col("t"), q["p"]) | F.contains(F.col("norm"), q["norm"]) | F.coalesce(F.contains(F.lower("t"), low(q["drug"])), F.lit(False))
    texts = sections.withColumn("norm", X.conservative(F.col("t")))
    direct = texts.withColumn("q", F.explode(F.filter(block, may)))
    near = stage(search.cosine_near(sections.select("h", "t"), "h", "t", table.select("phrase_id", "p"), "phrase_id", "p", threshold).distinct(), "near")
    by_id = F.map_from_entries(F.transform(block, lambda q: F.struct(q["id"], q)))
    alike = texts.join(broadcast_if_small(near.select("h", "phrase_id")), "h").withColumn("q", F.element_at(by_id, F.col("phrase_id"))).drop("phrase_id")
    # a pair found both ways once: staged, so that facts are read from few texts
    pairs = stage(direct.unionByName(alike).distinct(), "pairs").withColumn("phrase_id", F.col("q.id"))
    pairs = pairs.join(broadcast_if_small(near), ["phrase_id", "h"], "left").withColumn("k", F.struct(*[c for c in K.key_information(F.col("t"))]))
    a, b = low(F.col("q.drug")), low(F.col("k.drug"))
    conflict = F.coalesce((a != b) & ~F.contains(a, b) & ~F.contains(b, a), F.lit(False))
    same = lambda f: F.coalesce(low(F.col(f"q.{f}")) == low(F.col(f"k.{f}")), F.lit(False))
    layer = (
        F.when(F.contains("t", F.col("q.p")), "exact_match")
        .when(F.contains("norm", F.col("q.norm")), "normalized_match")
        .when(same("drug") & (same("dose") | same("route")), "structured_match")
        .when(F.col("similarity").isNotNull(), "semantic_match")
    )
    found = pairs.where(~conflict).withColumn("layer", layer).where("layer is not null")
    opening = F.col("t") if snippet is None else F.left("t", F.lit(snippet))
    first = found.groupBy("phrase_id", "document", "section", F.md5(opening).alias("snippet")).agg(F.min(F.struct("o", "row_id", "layer", "similarity", F.col("q.p").alias("p"), "t")).alias("x"))
    out = first.select("phrase_id", "x.row_id", "section", "x.layer", F.when(F.col("x.layer").isin("exact_match", "normalized_match"), "DIRECT").otherwise("INDIRECT").alias("relevance"), "x.similarity", *(["x.p", "x.t"] if scores else []))
    if not scores:
        return out
    named = [F.lit(d) for d in C.DIMENSIONS]
    compared = C.compare(out, "p", "t", "section", "section")
    return compared.select(*out.columns[:-2], F.map_from_arrays(F.array(*named), F.array(*[f"{d}_status" for d in C.DIMENSIONS])).alias("statuses"), F.map_from_arrays(F.array(*named), F.array(*[f"{d}_score" for d in C.DIMENSIONS])).alias("scores"), "false_match")
