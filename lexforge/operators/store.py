"""The candidate store as tables: registration, removal with its dependants, upserts, ordered reads.

Tables are values here: each function returns the new content, to be written as one overwrite or append.
Defined results: registering a document twice keeps the later; documents with an equal fingerprint keep
the latest only; null ids are never registered; removing unknown ids changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def register(documents: DataFrame, document_id: str, fingerprint: str, order: str) -> DataFrame:
    """The documents that are kept: the latest row of each id, then the latest id of each fingerprint.

    Both are maxima, combined map-side; ties go to the greater id.
    """
    rest = [c for c in documents.columns if c not in (document_id, order)]
    by_id = documents.where(F.col(document_id).isNotNull()).groupBy(document_id).agg(F.max(F.struct(order, *rest)).alias("x")).select(document_id, "x.*")
    others = [c for c in by_id.columns if c not in (fingerprint, order, document_id)]
    known = by_id.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.max(F.struct(order, document_id, *others)).alias("x")).select(fingerprint, "x.*")
    return known.unionByName(by_id.where(F.col(fingerprint).isNull()))


def remove(table: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """table without the rows whose key is removed; the same call serves documents, chunks and items."""
    gone = removed.select(F.col(removed.columns[0]).alias("_gone")).where("_gone is not null").distinct()
    return table.join(gone, table[key] == gone["_gone"], "left_anti")


def upsert(table: DataFrame, key: str, order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; columns of keep_first come from the first row."""
    rest = [c for c in table.columns if c not in (key, order, *keep_first)]
    firsts = [F.min(F.struct(F.col(order), F.col(c))).alias(f"_f_{c}") for c in keep_first]
    rows = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x"), *firsts)
    return rows.select(key, "x.*", *[F.col(f"_f_{c}.{c}").alias(c) for c in keep_first])


def latest(table: DataFrame, order: str, n: int, where: str | None = None) -> DataFrame:
    """The n last rows in order, of those that fulfil a condition; only n rows of each task move."""
    rows = table.where(where) if where else table
    return rows.orderBy(F.col(order).desc(), *[F.col(c) for c in table.columns if c != order]).limit(n)


def retain(files: DataFrame, table: str, document_id: str = "document_id", content: str = "content") -> DataFrame:
    """Append source bytes that the table (a Parquet folder) does not hold yet; what was retained never changes.

    Returns the rows added: document_id, content, n_bytes and sha256. Null ids or bytes are not retained.
    """
    spark = files.sparkSession
    rows = files.where(F.col(document_id).isNotNull() & F.col(content).isNotNull()).select(F.col(document_id).alias("document_id"), F.col(content).alias("content"), F.octet_length(content).alias("n_bytes"), F.sha2(content, 256).alias("sha256")).dropDuplicates(["document_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(table).select("document_id"), "document_id", "left_anti")
    added = stage(rows, "retained")
    added.write.mode("append").parquet(table)
    return added


def create_table(spark, name: str, schema: str, path: str, partition: tuple[str, ...] = ()) -> None:
    """A Parquet table at path, laid out by its partition columns; nothing happens if it is there."""
    by = f" PARTITIONED BY ({', '.join(partition)})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by} LOCATION '{path}'")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def events_of(events: DataFrame, change: str, change_id, order: str, n: int | None = None) -> DataFrame:
    """The events of one change in order; n: only its last ones."""
    rows = events.where(F.col(change) == change_id)
    return rows.orderBy(order) if n is None else rows.orderBy(F.col(order).desc()).limit(n)


def documents_of(contents: DataFrame, content_id: str, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(content_id, document_id, found_by): the document of each content id: its chunk's, else its item's, else the id without ``_item``.

    Ids that stand several times in chunks or items take the least document id.
    """
    asked = contents.select(F.col(content_id).alias("content_id")).where("content_id is not null").distinct()
    first = lambda df, key, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("content_id")).agg(F.min("document_id").alias(name))
    rows = asked.join(first(chunks, "chunk_id", "_chunk"), "content_id", "left").join(first(items, "content_id", "_item"), "content_id", "left")
    stem = F.when(F.endswith("content_id", F.lit("_item")), F.regexp_replace("content_id", "_item$", ""))
    by = F.when(F.col("_chunk").isNotNull(), "chunk").when(F.col("_item").isNotNull(), "item").when(stem.isNotNull(), "stem")
    return rows.select("content_id", F.coalesce("_chunk", "_item", stem).alias("document_id"), by.alias("found_by"))
