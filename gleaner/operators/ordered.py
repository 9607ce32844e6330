"""Ordered lookups within a group that stay parallel when one group holds most of the rows.

A plain window sorts a whole group in one task.  Here a group is cut into time chunks: each
chunk is a window of its own, and what a chunk needs from the others comes from one summary row
per chunk.  Only summaries are ever sorted per group, and their number is bounded by the time
span, not by the number of rows.

Rows are spread by group and chunk explicitly: a plan that is already laid out by group would
satisfy a window over group and chunk as well, and all chunks of a group would share a task.  For
the same reason the inputs should be stored tables, not the direct result of a join on the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small, by_shuffle, cut_lineage

HOUR = 3600


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    values: Mapping[str, Column],
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """For each row, the latest non-null value among the earlier rows of its group.

    Rows are ordered by (``ts``, ``tie``).  Adds one column per entry of ``values``.
    """
    chunk = [*keys, "_chunk"]
    order = F.struct(F.col(ts), F.col(tie))
    rows = df.withColumns(
        {"_chunk": time_chunk(F.col(ts), chunk_seconds)}
        | {f"_value_{name}": value for name, value in values.items()}
    )
    before_in_chunk = (
        Window.partitionBy(*chunk).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    before_by_chunk = (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summaries = rows.groupBy(*chunk).agg(
        *[
            F.max_by(
                f"_value_{name}", F.when(F.col(f"_value_{name}").isNotNull(), order)
            ).alias(f"_last_{name}")
            for name in values
        ]
    )
    carried = summaries.select(
        *[F.col(c).alias(f"_k_{c}") for c in chunk],
        *[
            F.last(f"_last_{name}", ignorenulls=True).over(before_by_chunk).alias(f"_carry_{name}")
            for name in values
        ],
    )
    local = rows.repartition(*chunk).withColumns(
        {
            f"_local_{name}": F.last(f"_value_{name}", ignorenulls=True).over(before_in_chunk)
            for name in values
        }
    )
    same_chunk = [local[c].eqNullSafe(carried[f"_k_{c}"]) for c in chunk]
    return local.join(carried, same_chunk, "left").select(
        *[local[c] for c in df.columns if c not in values],
        *[
            F.coalesce(F.col(f"_local_{name}"), F.col(f"_carry_{name}")).alias(name)
            for name in values
        ],
    )


def earliest_at_or_after(
    items: DataFrame, probes: DataFrame, keys: Sequence[str], chunk_seconds: int = 600
) -> DataFrame:
    """For each probe (keys, at), the first item (keys, ts, id) of its group with ts >= at.

    Returns the distinct probes with ``hit`` = struct(ts, id), null if there is none.  Equal
    items collapse before they are shuffled, so copies of one text at one time cost one row.
    """
    slim = items.groupBy(*keys, "ts").agg(F.min("id").alias("id"))
    item_rows = slim.select(
        *keys,
        time_chunk(F.col("ts"), chunk_seconds).alias("_chunk"),
        F.col("ts").alias("at"),
        F.struct("ts", "id").alias("hit"),
        F.lit(0).alias("_probe"),
    )
    probe_rows = (
        probes.select(*keys, "at")
        .distinct()
        .select(
            *keys,
            time_chunk(F.col("at"), chunk_seconds).alias("_chunk"),
            "at",
            F.lit(None).cast(item_rows.schema["hit"].dataType).alias("hit"),
            F.lit(1).alias("_probe"),
        )
    )
    # Latest first, items before probes at one instant: what precedes a probe is at or after it.
    from_end = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(F.desc("at"), "_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_chunk = (
        item_rows.unionByName(probe_rows)
        .repartition(*keys, "_chunk")
        .withColumn("_near", F.last("hit", ignorenulls=True).over(from_end))
        .filter("_probe = 1")
        .select(*keys, "_chunk", "at", "_near")
    )
    # Probes that found nothing in their own chunk take the first item of the next used chunk.
    open_chunks = in_chunk.filter("_near IS NULL").select(*keys, "_chunk").distinct()
    chunk_starts = item_rows.groupBy(*keys, "_chunk").agg(F.min("hit").alias("hit"))
    later_chunks = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_chunk"), F.desc("_probe"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    by_chunk = (
        chunk_starts.withColumn("_probe", F.lit(0))
        .unionByName(
            open_chunks.withColumn("_probe", F.lit(1)), allowMissingColumns=True
        )
        .withColumn("_far", F.last("hit", ignorenulls=True).over(later_chunks))
        .filter("_probe = 1")
        .select(*keys, "_chunk", "_far")
    )
    return in_chunk.join(by_shuffle(by_chunk), [*keys, "_chunk"], "left").select(
        *keys, "at", F.coalesce("_near", "_far").alias("hit")
    )


def latest_rows(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current state of a change log: the last row per key.

    An aggregate, not a window: partial maxima are formed before the shuffle, so a key with very
    many changes sends one row per task.
    """
    rest = [c for c in log.columns if c not in keys]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(*keys, "_last.*")
    )


def numbered(rows: DataFrame, order: Sequence[str], position: str) -> DataFrame:
    """Stored ``rows`` with their place, from 0, in the ``order`` and the task range ``_range``.

    Rows are laid out by ranges of the order; only the count of each range is summed up.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = cut_lineage(laid.withColumns({"_range": F.spark_partition_id(), "_index": index}))
    sizes = stored.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the layout.
    starts = sizes.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return stored.join(broadcast_if_small(starts), F.col("_range") == F.col("_r")).select(
        *rows.columns, "_range", (F.col("_start") + F.col("_index")).alias(position)
    )

