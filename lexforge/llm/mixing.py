"""Mixing sources to target weights (problem 7).

Every document gets a hash-random key; within each source documents are sorted by key through fixed ranges
of the key space (the keys are uniform, so the ranges are even and no source, however large, sits in one
task), token counts are summed by range, the ranges' sums are carried forward, and each source is cut at
its exact budget. A budget beyond the source's tokens takes whole epochs first.

The total is the largest at which every source with tokens reaches its target share within its cap; a
smaller ``budget`` may be given. Token counts come from a public tokenizer.

Defined results: null ids, null texts and sources without a target give no uses; source names are compared
without case and outer blanks; texts without tokens are never used; a source without tokens contributes
nothing and the others keep their budgets; a repeated row of one id counts once (the longest text).
Equal keys are ordered by id.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_if_small, stage

#: Where the vocabulary of the public tokenizer lies on the driver; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents in one range of the key space, about.
RANGE_ROWS = 50_000


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """df without its text and with the number of tokens of it; null for null texts.

    The vocabulary travels with the job, so executors need not have it.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    file = os.path.basename(vocabulary)
    kept = [f for f in df.schema.fields if f.name != text]
    names = [*[f.name for f in kept], out]

    def run(batches):
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [None if t is None else len(encode(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.select(text, *[f.name for f in kept]).mapInArrow(run, f"{fields}, `{out}` long")


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def mix(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, budget: int | None = None, seed: int = 0, range_rows: int = RANGE_ROWS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, shares).

    uses: doc_id, source, n_tokens, uses of every document that is used. shares: source, target_share,
    actual_share, n_tokens, n_docs, most_uses and shortfall in tokens of every target, one row each.
    targets (source, target_share, max_repeats) is a reference table, one row a source; it is broadcast only
    while its size allows.
    """
    spark = docs.sparkSession
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(source_key(F.col("source")).alias("key")).agg(F.first("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # staged, so that its size is known
    wanted = stage(wanted, "targets")
    rows = docs.select(F.col(doc_id).alias("id"), source_key(F.col(source)).alias("key"), F.col(text).alias("text"))
    rows = rows.where("id is not null and text is not null").join(broadcast_if_small(wanted.select("key")), "key", "left_semi")
    counted = count_tokens(rows, "text").where("n_tokens > 0")
    # one row for each id: combined map-side, whatever the source's size
    counted = stage(counted.groupBy("id").agg(F.max(F.struct("n_tokens", "key")).alias("x")).select("id", "x.*"), "tokens")
    ranges = max(1, -(-counted.count() // range_rows))
    # the upper bits of a uniform hash: equal ranges of the key space
    placed = counted.withColumn("rand", F.xxhash64(F.lit(seed), "id")).withColumn("range", F.floor((F.col("rand") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    sums = stage(placed.groupBy("key", "range").agg(F.sum("n_tokens").alias("range_tokens"), F.count("*").alias("range_docs")), "ranges")
    totals = sums.groupBy("key").agg(F.sum("range_tokens").alias("tokens"))
    plan = wanted.join(totals, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # one row for each source; a source without tokens bounds nothing
    limit = plan.where("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    total = limit if budget is None else min(float(budget), limit)
    plan = plan.withColumn("budget", F.least(F.floor(F.col("target_share") * F.lit(total)).cast("long"), F.col("tokens") * F.col("max_repeats")))
    plan = plan.withColumn("epochs", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = stage(plan, "plan")
    # prefix sums: of whole ranges (few rows), then within each range
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("carried", F.coalesce(F.sum("range_tokens").over(before), F.lit(0))).join(broadcast_if_small(plan.select("key", "epochs", "rest")), "key")
    # a range wholly before the cut, or wholly after it, needs no order within it
    carried = carried.withColumn("side", F.when(F.col("carried") + F.col("range_tokens") <= F.col("rest"), 1).when(F.col("carried") >= F.col("rest"), -1).otherwise(0))
    known = placed.join(broadcast_if_small(stage(carried.select("key", "range", "carried", "epochs", "rest", "side"), "carried")), ["key", "range"])
    within = Window.partitionBy("key", "range").orderBy("rand", "id").rowsBetween(Window.unboundedPreceding, 0)
    cut = known.where("side = 0").withColumn("extra", (F.col("carried") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("int"))
    whole = known.where("side != 0").withColumn("extra", (F.col("side") == 1).cast("int"))
    all_uses = whole.unionByName(cut).withColumn("uses", (F.col("epochs") + F.col("extra")).cast("long")).where("uses > 0")
    names = broadcast_if_small(wanted.select("key", "source"))
    uses = all_uses.join(names, "key").select(F.col("id").alias(doc_id), "source", "n_tokens", "uses")
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    reached = plan.select("source", "target_share", "budget").join(used, "source", "left").na.fill(0, ["n_tokens", "n_docs", "most_uses"])
    # one row for each source
    reached = reached.withColumn("every", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    shares = reached.select("source", "target_share", F.when(F.col("every") > 0, F.col("n_tokens") / F.col("every")).otherwise(0.0).alias("actual_share"), "n_tokens", "n_docs", "most_uses", F.floor(F.col("target_share") * F.lit(total) - F.col("n_tokens")).alias("shortfall"))
    return uses, shares
