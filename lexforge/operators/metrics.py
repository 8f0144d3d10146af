"""Retrieval and detection measures over ranked lists and labels.

Defined results: without relevant rows recall is 1; a query without results has 0 for all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, k: int) -> DataFrame:
    """recall, precision, hit_rate at k and reciprocal rank of each query.

    ranked: query, rank, is_relevant; relevant: query, n_relevant (one row for each query).
    """
    top = F.col("is_relevant") & (F.col("rank") <= k)
    per = ranked.groupBy(query).agg(F.count_if(top).alias("hits"), F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first"))
    rows = relevant.join(per, query, "left").na.fill(0, ["hits"])
    return rows.select(
        query,
        F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.bround(F.col("hits") / F.col("n_relevant"), 4)).alias("recall"),
        F.bround(F.col("hits") / F.lit(k), 4).alias("precision"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"),
        F.coalesce(F.bround(1.0 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"),
    )


def outcome(expected: Column, flagged: Column) -> Column:
    """TP, TN, FP or FN."""
    return F.when(expected & flagged, "TP").when(~expected & ~flagged, "TN").when(flagged, "FP").otherwise("FN")


def grounded(quote: Column, source: Column, prefix: int | None = 50) -> Column:
    """Whether a quote, or its first ``prefix`` characters (None: only the whole), stands in the source, without case and white space runs."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    q, s = flat(quote), flat(source)
    found = F.contains(s, q) if prefix is None else F.contains(s, q) | F.contains(s, F.left(q, F.lit(prefix)))
    return F.coalesce((q != "") & (s != "") & found, F.lit(False))
