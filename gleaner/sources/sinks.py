"""Parquet tables the jobs write, and JSON exports.

A micro-batch owns the folder ``batch_id=N`` of a table and replaces it when it is repeated, so
a batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import path_exists

DAY_BLOCKS = 64


def write_batch(df: DataFrame, table: str, batch_id: int, partitions: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{table}/batch_id={batch_id}")


def write_in_order(df: DataFrame, table: str, batch_id: int, order: tuple[str, ...]) -> None:
    """``write_batch`` with the rows in order of time, for tables that are read from some time on.

    Files are cut by size, so their number does not grow with the days a batch spans; a reader
    skips those whose statistics lie outside what it asks for.  ``df`` should be a stored table,
    since it is sampled first.
    """
    write_batch(df.repartitionByRange(*order).sortWithinPartitions(*order), table, batch_id)


def in_blocks(number: Column, low: int | None, high: int | None, blocks: int) -> Column:
    """The last number of the block that ``number`` falls in: at most ``blocks`` of them from
    ``low`` to ``high``, one for each number where there are no more numbers than that."""
    if low is None:
        return number
    size = -(-(high - low + 1) // blocks)
    return F.least(F.lit(low) + (F.floor((number - low) / size) + 1) * size - 1, F.lit(high))


def write_raw_items(items: DataFrame, table: str, batch_id: int) -> None:
    """All items, rejected ones too, by circuit and stretches of days.

    Days have no folders of their own here: a batch may span any number of them.  ``jobs.compact``
    lays what is kept out by day.
    """
    dated = items.withColumn("ingest_date", F.to_date("created_at"))
    day = F.unix_date("ingest_date")
    ends = dated.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    block = in_blocks(day, ends["low"], ends["high"], DAY_BLOCKS)
    # Adaptive execution joins small blocks in one task and splits one that holds most of the rows.
    even = dated.withColumn("_block", block).hint("rebalance", "_block", "circuit").drop("_block")
    write_batch(even, table, batch_id, ("circuit",))


def write_matches(matches: DataFrame, table: str, batch_id: int) -> None:
    write_batch(matches, table, batch_id, ("circuit",))


def usage_rows(calls: DataFrame, default_model: str) -> DataFrame:
    """Usage-log rows of classifier calls; a call without a model gets the default."""
    return calls.select(
        "match_id",
        "mode",
        F.coalesce("circuit", F.lit("main")).alias("circuit"),
        F.coalesce("model", F.lit(default_model)).alias("model"),
        "outcome",
        "prompt_tokens",
        "output_tokens",
        "latency_ms",
        "error",
        "created_at",
    )


def write_usage(calls: DataFrame, table: str, batch_id: int, default_model: str) -> None:
    write_batch(usage_rows(calls, default_model), table, batch_id)


def current_version(spark: SparkSession, table: str) -> tuple[int, int]:
    """The last whole version of a compacted table and the last batch in it; (0, -1) before any.

    Versions lie in ``<table>-versions`` as ``version=N``; the marker of a version, an empty file
    that is made when all of it is written, names the batch.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}-versions/markers")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, -1
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((tuple(map(int, name.split("-"))) for name in names), default=(0, -1))


def write_version(
    df: DataFrame, table: str, version: int, upto: int, partitions: tuple[str, ...] = ()
) -> None:
    """Write a version that stands for all batches up to ``upto``, then make it the current one.

    A version that was left unfinished is overwritten; a finished one is refused.
    """
    spark = df.sparkSession
    if current_version(spark, table)[0] >= version:
        raise ValueError(f"version {version} of {table} exists")
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{table}-versions/version={version}")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{table}-versions/markers/{version}-{upto}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, False).close()


def drop_replaced(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Delete batches and versions that the ``keep`` newest versions do not need.

    Markers stay, so the numbers go on.
    """
    version, _ = current_version(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    markers = {}
    folder = path(f"{table}-versions/markers")
    if files.exists(folder):
        for status in files.listStatus(folder):
            number, upto = map(int, status.getPath().getName().split("-"))
            markers[number] = upto
    oldest = version - keep + 1
    for number in markers:
        if number < oldest:
            files.delete(path(f"{table}-versions/version={number}"), True)
    if oldest in markers and files.exists(path(table)):
        for status in files.listStatus(path(table)):
            name = status.getPath().getName()
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= markers[oldest]:
                files.delete(status.getPath(), True)


def read_table(
    spark: SparkSession, table: str, schema: str, before_batch: int | None = None
) -> DataFrame:
    """A table written by batches, with the columns of ``schema``; empty if there is none yet.

    Only a missing folder counts as an empty table: any other error is the caller's to see.
    ``before_batch`` hides the batch being written and later ones.  Batches that a version has
    replaced are read from it, unless ``before_batch`` lies within them.
    """
    columns = f"{schema}, batch_id BIGINT"
    version, upto = current_version(spark, table)
    if before_batch is not None and before_batch <= upto:
        version, upto = 0, -1
    parts = []
    if path_exists(spark, table):
        df = spark.read.schema(columns).parquet(table)
        df = df if before_batch is None else df.filter(F.col("batch_id") < before_batch)
        parts.append(df if upto < 0 else df.filter(F.col("batch_id") > upto))
    if version:
        compacted = spark.read.schema(schema).parquet(f"{table}-versions/version={version}")
        parts.append(compacted.withColumn("batch_id", F.lit(upto).cast("bigint")))
    if not parts:
        return spark.createDataFrame([], columns)
    return functools.reduce(DataFrame.unionByName, parts)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
