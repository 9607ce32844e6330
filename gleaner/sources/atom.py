"""Atom feeds as item tables, in batch and as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.entities import unescape
from gleaner.functions.text import extract_body, extract_tag
from gleaner.session import bound_arrow_batches

# Repeatable elements are arrays, of which the first counts.
ENTRY = (
    "id STRING, title STRING, category ARRAY<STRUCT<_term: STRING>>, "
    "link ARRAY<STRUCT<_href: STRING>>, author STRUCT<name: STRING>, published STRING, "
    "content STRUCT<_type: STRING, _VALUE: STRING>"
)


def _options(reader):
    return (
        reader.format("xml")
        .schema(ENTRY)
        .option("rowTag", "entry")
        .option("ignoreSurroundingSpaces", "false")
    )


def entries_to_items(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Feed entries as item rows; an entry without id or title is skipped."""
    bound_arrow_batches(entries.sparkSession)
    named = entries.filter(F.col("id").isNotNull() & (F.length("title") > 0)).withColumns(
        {
            "_title": unescape(F.col("title")),
            "_content": extract_body(F.col("content._VALUE"), start, end),
        }
    )
    author = F.element_at(F.split(F.coalesce("author.name", F.lit("")), "/"), -1)
    return named.select(
        F.col("id").alias("item_id"),
        F.try_element_at("category", F.lit(1))["_term"].alias("source"),
        F.col("_title").alias("title"),
        F.col("_content.body").alias("body"),
        F.col("_content.has_body").alias("has_body"),
        extract_tag(F.col("_title")).alias("tag"),
        F.nullif(author, F.lit("")).alias("author_handle"),
        F.try_element_at("link", F.lit(1))["_href"].alias("permalink"),
        F.try_to_timestamp("published").alias("posted_at"),
    )


def read_atom(spark: SparkSession, path: str, **sentinels: str) -> DataFrame:
    """Items of saved feeds: one file or a folder of them."""
    return entries_to_items(_options(spark.read).load(path), **sentinels)


def read_atom_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None, **sentinels: str
) -> DataFrame:
    """Items of feed files as they arrive in a folder."""
    reader = _options(spark.readStream)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return entries_to_items(reader.load(path), **sentinels)
