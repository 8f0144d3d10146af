"""Structured Streaming forms: windowed counts, arriving documents without copies, ledgers, latest rows.

State is bounded by watermarks; sinks are idempotent by batch number, so a batch that is run again after
a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ledger as L


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sum of value for each window and key; rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n", "total")


def new_documents(docs: DataFrame, text: str, time: str, horizon: str = "1 day") -> DataFrame:
    """Documents whose fingerprint has not arrived within the horizon before."""
    prints = docs.withColumn("fingerprint", X.fingerprint(F.col(text)))
    if not docs.isStreaming:
        return prints.dropDuplicates(["fingerprint"])
    return prints.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def start_windows(stream: DataFrame, time: str, key: str, out: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours"):
    """``windowed_counts`` of a stream, written batch by batch; read back by ``windows``.

    Each batch writes the windows that changed (update mode), so the watermark drops late rows and the state
    of windows that are over, and windows still open are readable too.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts = windowed_counts(stream, time, key, width, late)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(spark, out: str, key: str) -> DataFrame:
    """The last state of each window and key over all batches."""
    rows = spark.read.parquet(f"{out}/batch=*").groupBy("window_start", key).agg(F.max(F.struct("_batch", "n", "total")).alias("x"))
    return rows.select("window_start", key, "x.n", "x.total")


def start_latest(stream: DataFrame, key: str, order: str, out: str, checkpoint: str):
    """Keep the latest row of each key: every batch writes its own folder, read back by ``latest``."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).withColumn("_batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, out: str, key: str, order: str) -> DataFrame:
    """The latest row of each key over all batches; on equal order the later batch's.

    One aggregation, combined map-side.
    """
    rows = spark.read.parquet(f"{out}/batch=*")
    columns = [c for c in rows.columns if c not in (key, order, "_batch", "batch")]
    best = F.max(F.struct(order, "_batch", *columns)).alias("x")
    return rows.groupBy(key).agg(best).select(key, f"x.{order}", *[f"x.{c}" for c in columns])


def start_ledger(stream: DataFrame, ledger: str, order: str, out: str, checkpoint: str):
    """Append each batch's events to their ledgers' chains; every batch is one folder of the chain table.

    Beside it, in ``<out>_heads``, each batch writes the last event of every ledger so far, so the next one
    reads one row a ledger and never the chain.
    """
    heads = f"{out}_heads"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _last_before(spark, heads, number)
        fresh = L.build_chain(batch, ledger, order) if last is None else continue_chain(batch, ledger, order, last)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        own = spark.read.parquet(f"{out}/batch={number}").groupBy(ledger).agg(F.max(F.struct("seq", "event_hash")).alias("last"))
        every = own if last is None else own.unionByName(last).groupBy(ledger).agg(F.max("last").alias("last"))
        every.write.mode("overwrite").parquet(f"{heads}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_before(spark, heads: str, number: int) -> DataFrame | None:
    """The heads written by the latest earlier batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(heads)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    earlier = [n for n in (int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)) if n < number] if fs.exists(path) else []
    return spark.read.parquet(f"{heads}/batch={max(earlier)}") if earlier else None


def continue_chain(batch: DataFrame, ledger: str, order: str, last: DataFrame) -> DataFrame:
    """The batch's events chained to the last stored event of their ledgers."""
    heads = last.select(F.col(ledger), F.col("last.seq").alias("_seq"), F.col("last.event_hash").alias("_hash"))
    rows = batch.join(heads, ledger, "left")
    return L.build_chain(rows, ledger, order, start=("_seq", "_hash")).drop("_seq", "_hash")
