"""JSON messages of the raw stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.text import extract_tag

_CORRUPT = "_corrupt"


def parse_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages as item columns plus ``problem``: null, or why the message cannot be used."""
    item = F.from_json(
        F.col(column).cast("string"),
        f"{schemas.MESSAGE}, {_CORRUPT} STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )
    rows = messages.select(F.col(column).cast("string").alias("raw"), item.alias("i"))
    rows = rows.select("raw", "i.*").withColumn("_posted", F.try_to_timestamp("posted_at"))
    problem = (
        F.when(F.col(_CORRUPT).isNotNull() | F.col("raw").isNull(), "not_json")
        .when(F.coalesce(F.length("source"), F.lit(0)) == 0, "no_source")
        .when(F.col("title").isNull(), "no_title")
        .when(F.col("item_id").isNull(), "no_item_id")
        .when(F.col("_posted").isNull(), "bad_posted_at")
    )
    return rows.select(
        "item_id",
        "source",
        "title",
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("has_body", F.lit(False)).alias("has_body"),
        F.coalesce("tag", extract_tag(F.col("title"))).alias("tag"),
        "author_handle",
        "permalink",
        F.col("_posted").alias("posted_at"),
        problem.alias("problem"),
        "raw",
    )


def good_items(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NULL").drop("problem", "raw")


def bad_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NOT NULL").select("problem", "raw")


def read_message_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Text files with one message per line, as a stream with the column ``value``."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_message_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )
