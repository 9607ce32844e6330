"""Call quotas per circuit: who is admitted, and how much is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed


def _first_per_group(calls: DataFrame, group: list[str], limit: int) -> DataFrame:
    # Spark turns a rank filter into a group limit before the shuffle, so a minute with very
    # many calls sends only ``limit`` rows per task.
    window = Window.partitionBy(*group).orderBy("ts", "id")
    return (
        calls.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def admit_calls(
    calls: DataFrame, per_minute: int = fixed.CALLS_PER_MINUTE, per_day: int = fixed.CALLS_PER_DAY
) -> DataFrame:
    """Add ``admission`` to calls (id, circuit, ts): ok, minute_limit or day_limit.

    The minute limit comes first, and a call it refuses does not use up the day.  Minutes and
    UTC days are calendar ones.
    """
    keyed = calls.select(
        "id",
        "circuit",
        "ts",
        F.date_trunc("minute", "ts").alias("_minute"),
        F.to_date("ts").alias("_day"),
    )
    in_minute = _first_per_group(keyed, ["circuit", "_minute"], per_minute)
    in_day = _first_per_group(in_minute, ["circuit", "_day"], per_day)
    passed = (
        in_minute.select("id", F.lit(1).alias("_level"))
        .unionByName(in_day.select("id", F.lit(2).alias("_level")))
        .groupBy("id")
        .agg(F.max("_level").alias("_level"))
    )
    return (
        calls.join(passed, "id", "left")
        .withColumn(
            "admission",
            F.when(F.col("_level") == 2, "ok")
            .when(F.col("_level") == 1, "day_limit")
            .otherwise("minute_limit"),
        )
        .drop("_level")
    )


def quota_usage(
    calls: DataFrame,
    now: Column,
    per_minute: int = fixed.CALLS_PER_MINUTE,
    per_day: int = fixed.CALLS_PER_DAY,
) -> DataFrame:
    """Per circuit: calls used today and in this minute, against the limits.

    Like the counters, the day only counts calls that the minute limit let through.
    """
    today = calls.filter((F.col("ts") <= now) & (F.to_date("ts") == F.to_date(now)))
    minutes = today.groupBy("circuit", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("n")
    )
    return minutes.groupBy("circuit").agg(
        F.sum(F.least("n", F.lit(per_minute))).alias("day_used"),
        F.lit(per_day).alias("day_limit"),
        F.coalesce(
            F.sum(F.when(F.col("minute") == F.date_trunc("minute", now), F.col("n"))), F.lit(0)
        ).alias("min_used"),
        F.lit(per_minute).alias("min_limit"),
    )
