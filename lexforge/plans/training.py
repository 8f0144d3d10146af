"""Queries of the general training-data problems (1, 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants, nested, units
from ..session import read, read_spread


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All objects of proposals.data and of content_items.metadata."""
    return (
        nested.objects(read_spread(spark, sf_dir, "proposals", "change_id", "data"), "change_id", "data"),
        nested.objects(read_spread(spark, sf_dir, "content_items", "content_id", "metadata"), "content_id", "metadata"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identified object of proposals.data and content_items.metadata with its parent."""
    proposals, items = _objects(spark, sf_dir)
    return nested.identified(proposals).unionByName(nested.identified(items))


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that all records flatten to, one below the other: each object with the row of its parent.

    A delivery repeated word for word counts once. Columns, which differ from table to table, are given as
    the JSON of a row.
    """
    sources = (("proposals", "change_id", "data"), ("content_items", "content_id", "metadata"))
    parts = []
    for table, record_id, data in sources:
        rows = read_spread(spark, sf_dir, table, record_id, data).distinct()
        for path, rows in nested.group_tables(nested.stage_objects(nested.objects(rows, record_id, data))).items():
            fixed = ["record_id", "delivery", "node", "parent_path", "parent_node", "ordinals"]
            columns = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in fixed])) if len(rows.columns) > len(fixed) else F.lit("{}")
            parts.append(rows.select(F.lit(table).alias("source_table"), F.lit(path).alias("table_path"), *fixed, columns.alias("fields")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p1_path_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table and field that the records hold: objects, values and nulls."""
    both = nested.shred(read_spread(spark, sf_dir, "proposals", "change_id", "data"), "change_id", "data").unionByName(nested.shred(read_spread(spark, sf_dir, "content_items", "content_id", "metadata"), "content_id", "metadata"))
    return both.groupBy("table_path", "field").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_values"), F.max(F.length("value")).alias("longest"))


def _doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = "key_information"
    return read_spread(spark, sf_dir, "content_items", "content_id", "text", info).select("content_id", "text", *[F.col(f"{info}.{c}").alias(c) for c in ("dose", "dose_unit", "frequency")])


def p2_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated dose with its cheapest combination of units, its residual, and whether that is unique."""
    return units.normalise_doses(_doses(spark, sf_dir), "content_id", read(spark, sf_dir, "unit_standards"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute doses of content_items in base units, with their interval.

    The rows of p2_amounts whose unit stands in one of the places of the query's definition; a number with
    two units behind it has no single reading there.
    """
    decided = p2_amounts(spark, sf_dir).where("unit_source != 'implied' and not tied")
    return decided.select("content_id", "kind", "amount_low", "amount_high", "interval_min").distinct()


def p2_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the stated doses agree with the amounts in their texts, by kind and place of the unit."""
    amounts = p2_amounts(spark, sf_dir)
    return amounts.groupBy("kind", "unit_source", "is_unique", "tied").agg(F.count("*").alias("n"), F.count_if(F.col("log_residual") < 1e-9).alias("n_confirmed"), F.count_if(F.col("log_residual") >= 1e-9).alias("n_off"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of search_results.retrieved_at and provenance.publication_date."""
    feeds = read(spark, sf_dir, "source_feeds")
    sources = (("search_results", "search_id", "retrieved_at"), ("provenance", "provenance_id", "publication_date"))
    rows = [read(spark, sf_dir, t).select(F.col(i).alias("record_id"), "feed_id", F.col(c).alias("raw")) for t, i, c in sources]
    both = rows[0].unionByName(rows[1]).where("record_id is not null")
    known = instants.InstantDictionary(spark, feeds, instants.dictionary_path(spark, feeds))
    return known.normalise(both, "raw", "feed_id").select("record_id", "iso_utc").distinct()


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_path_profile": p1_path_profile, "p2_amounts": p2_amounts, "p2_found": p2_found, "p2_residuals": p2_residuals, "p5_found": p5_found}
ORACLES: dict[str, str] = {}
