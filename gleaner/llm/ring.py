"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``virtual_nodes`` points on a ring of 2^32 places.  A row starts at the first point
clockwise of its own hash.  A shard takes rows until its capacity is reached; the rest go on
clockwise to the next shard, so balance is guaranteed.  Capacities add up to the number of rows
and differ by one at most, hence the law ``rows``.

All rows between two points have the same way around the ring.  They are counted in small cells
(arc and hash bucket), and the overflow is worked out on the cell counts, one round per step
clockwise: in a round a shard takes the arriving cells in ring order until it is full and passes
on what is left of the cell at the border and those behind it.  After as many rounds as there are
shards nothing can be left.  Rows are only ever ranked within a cell.

Null texts have no bytes and the checksum of an empty text.  Rows are told apart by identifier,
checksum and size; repeated rows share a cell and get slots of their own in it.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import count_up_to
from gleaner.session import broadcast_if_small, cut_lineage

RING = 2**32
VIRTUAL_NODES = 128
ROWS_PER_CELL = 5_000
LEAST_BUCKETS = 4


def place(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(RING))


def as_digits(position: Column) -> Column:
    return F.lpad(position.cast("string"), 10, "0")


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int) -> list[tuple[str, int]]:
    """All points in ring order, as (position in digits, shard)."""
    shard, node = F.col("id") % F.lit(shards), F.floor(F.col("id") / F.lit(shards))
    points = spark.range(shards * virtual_nodes).select(
        as_digits(place(F.lit("point"), shard, node)).alias("at"), shard.alias("shard")
    )
    return [(r["at"], int(r["shard"])) for r in points.orderBy("at", "shard").collect()]


def ways(points: list[tuple[str, int]], shards: int) -> list[list[int]]:
    """For each point the shards in the order met clockwise from it."""
    following: list[list[int]] = []
    way: list[int] = []
    for _, shard in reversed(points + points):
        way = [shard, *(s for s in way if s != shard)]
        following.append(way)
    return following[::-1][: len(points)]


def chosen(shard: Column, values: dict[int, int]) -> Column:
    pairs = [F.lit(x) for pair in sorted(values.items()) for x in pair]
    return F.element_at(F.create_map(*pairs), shard)


def bounded_ring(docs: DataFrame, shards: int = 8, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    points = ring_points(spark, shards, virtual_nodes)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("at", place(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    # The point at or after a hash; behind the last one the ring starts again.
    before = count_up_to(as_digits(F.col("at") - 1), [at for at, _ in points])
    stored = cut_lineage(rows.withColumn("arc", F.pmod(before, F.lit(len(points))).cast("int")))
    total = stored.count()
    buckets = max(LEAST_BUCKETS, -(-total // (len(points) * ROWS_PER_CELL)))
    cells = stored.withColumn("bucket", F.pmod(F.xxhash64("at", F.lit("cell")), F.lit(buckets)).cast("int"))
    segments = broadcast_if_small(overflow(cells, ways(points, shards), total, shards))
    rank = Window.partitionBy("arc", "bucket").orderBy("at", "doc_id", "text_crc32", "size")
    ranked = cells.withColumn("rank", F.row_number().over(rank) - 1)
    in_segment = (
        (F.col("arc") == F.col("s_arc"))
        & (F.col("bucket") == F.col("s_bucket"))
        & (F.col("rank") >= F.col("first"))
        & (F.col("rank") < F.col("first") + F.col("taken"))
    )
    return ranked.join(segments, in_segment).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("rank") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def overflow(cells: DataFrame, order: list[list[int]], total: int, shards: int) -> DataFrame:
    """Which rows of each cell go to which shard: (s_arc, s_bucket, first, taken, shard, slot)."""
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    filled = dict.fromkeys(room, 0)
    way = F.split(F.lit("\n".join(",".join(map(str, w)) for w in order)), "\n")
    pending = cells.groupBy("arc", "bucket").agg(F.count(F.lit(1)).alias("left")).withColumn("first", F.lit(0))
    rounds = []
    for step in range(shards):
        shard = F.split(F.element_at(way, F.col("arc") + 1), ",")[step].cast("int")
        arriving = pending.withColumn("shard", shard)
        in_ring = Window.partitionBy("shard").orderBy("arc", "bucket")
        ahead = F.sum("left").over(in_ring) - F.col("left")
        free = chosen(F.col("shard"), room)
        stored = cut_lineage(
            arriving.withColumn("ahead", ahead)
            .withColumn("taken", F.greatest(F.lit(0), F.least(F.col("left"), free - F.col("ahead"))))
            .withColumn("slot", chosen(F.col("shard"), filled) + F.col("ahead"))
        )
        rounds.append(
            stored.where("taken > 0").select(
                F.col("arc").alias("s_arc"), F.col("bucket").alias("s_bucket"), "first", "taken", "shard", "slot"
            )
        )
        sums = stored.groupBy("shard").agg(F.sum("taken").alias("t"), F.sum(F.col("left") - F.col("taken")).alias("l"))
        taken = sums.collect()  # one row per shard
        for r in taken:
            room[r["shard"]] -= r["t"]
            filled[r["shard"]] += r["t"]
        if not any(r["l"] for r in taken):
            break
        pending = stored.where("left > taken").select(
            "arc", "bucket", (F.col("left") - F.col("taken")).alias("left"), (F.col("first") + F.col("taken")).alias("first")
        )
    return functools.reduce(DataFrame.unionAll, rounds)
