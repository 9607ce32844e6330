"""Exact deduplication by a content sort.

Rows are ordered by a key that begins with the first characters of the normalised text, then its
SHA-256, so that equal texts are neighbours and sampled splitters stay short.  Within equal texts
the longest original comes first, then the smallest identifier.  Splitters drawn from a sample of
whole keys cut that order into ranges: a text that a third of all rows share is spread over as many
ranges as its rows deserve.  Each range is sorted externally, and neighbours are compared by their
full normalised texts.  Groups that cross a border are linked through the first and last text of
each range, a table of one row per range.  Whole texts are shuffled once.

Null texts count as empty, and empty texts are equal to each other and to texts of white space.
Of repeated rows one stays.  A null identifier is larger than all others.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import count_up_to
from gleaner.session import cut_lineage

WHITE_SPACE = " \t\n\x0b\x0c\r"
KEY_CHARACTERS = 48
SAMPLES_PER_RANGE = 40
LONGEST = 10**10
NEW_COLUMNS = {
    "keep_id", "group_size", "kept", "text_sha256", "key", "range", "row", "starts", "last", "group",
    "norm", "border_text", "size", "keep", "in_range", "in_group", "continued", "chain_size",
    "chain_keep",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sortable(number: Column) -> Column:
    """A 64-bit integer as a string of the same order; null comes last."""
    shifted = number.cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    return F.coalesce(F.lpad(F.hex(shifted), 16, "0"), F.lit("~"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``norm``, its ``text_sha256`` and the sort ``key``, each computed once."""
    rows = docs.withColumn("norm", normalised(F.col("text")))
    rows = rows.withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
    key = F.concat(
        F.substring("norm", 1, KEY_CHARACTERS),
        F.lit("\t"),
        F.col("text_sha256"),
        F.lpad((F.lit(LONGEST) - F.coalesce(F.char_length("text"), F.lit(0))).cast("string"), 11, "0"),
        sortable(F.col("doc_id")),
    )
    return rows.withColumn("key", key)


def splitters(docs: DataFrame, ranges: int, seed: int = 20) -> list[str]:
    """Keys that cut the rows into ranges of about equal size; their number is bounded by ``ranges``."""
    rows = docs.count()
    if ranges < 2 or rows < 2:
        return []
    wanted = ranges * SAMPLES_PER_RANGE
    sample = docs if rows <= wanted else docs.sample(min(1.0, 1.1 * wanted / rows), seed)
    keys = sorted(r["key"] for r in keyed(sample).select("key").collect())
    chosen = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    return sorted(set(chosen))


def content_groups(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), ranges: int | None = None
) -> DataFrame:
    """``keep`` columns, keep_id, group_size, kept and text_sha256, one row per row of ``docs``."""
    clash = NEW_COLUMNS & set(keep)
    if clash:
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    bounds = splitters(docs, ranges)
    rows = keyed(docs).withColumn("range", count_up_to(F.col("key"), bounds).cast("int"))
    # Only one form of the text travels.
    rows, norm = (
        (rows.drop("norm"), normalised(F.col("text"))) if "text" in keep else (rows.drop("text"), F.col("norm"))
    )
    in_order = Window.partitionBy("range").orderBy("key")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    compared = (
        rows.repartitionById(len(bounds) + 1, F.col("range"))
        .withColumn("norm", norm)
        .withColumns(
            {
                "row": F.row_number().over(in_order),
                "starts": (~F.col("norm").eqNullSafe(F.lag("norm").over(in_order))).cast("int"),
                "last": F.lead(F.lit(False), 1, True).over(in_order),
            }
        )
        .withColumn("group", F.sum("starts").over(so_far))
        .select(
            *dict.fromkeys(["doc_id", *keep]),
            "text_sha256",
            "range",
            "group",
            "row",
            "last",
            "starts",
            F.when((F.col("row") == 1) | F.col("last"), F.col("norm")).alias("border_text"),
        )
    )
    group = Window.partitionBy("range", "group")
    grouped = cut_lineage(
        compared.withColumns(
            {
                "size": F.count(F.lit(1)).over(group),
                "keep": F.min(F.struct("row", "doc_id")).over(group)["doc_id"],
            }
        )
    )
    chains = linked_borders(grouped)
    same_group = (F.col("range") == F.col("in_range")) & (F.col("group") == F.col("in_group"))
    return grouped.join(F.broadcast(chains), same_group, "left").select(
        *keep,
        F.when(F.col("in_range").isNull(), F.col("keep")).otherwise(F.col("chain_keep")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        ((F.col("starts") == 1) & ~F.coalesce("continued", F.lit(False))).alias("kept"),
        "text_sha256",
    )


def linked_borders(grouped: DataFrame) -> DataFrame:
    """The groups at the borders of ranges, with size and survivor of the chain they belong to.

    At most two rows per range.  A range's first group continues the last group of the range
    before if their full texts are equal; a range with one group passes the chain on.
    """
    borders = grouped.where(F.col("border_text").isNotNull())
    first = F.struct("row", "border_text", "group", "size", "keep")
    ranges = borders.groupBy("range").agg(F.min(first).alias("first"), F.max(first).alias("final"))
    order = Window.orderBy("range")
    linked = ranges.withColumn(
        "continued",
        F.col("first.border_text").eqNullSafe(F.lag("final.border_text").over(order))
        & F.lag(F.lit(True), 1, False).over(order),
    )
    both = linked.select(
        F.col("range").alias("in_range"),
        F.explode(
            F.when(
                F.col("first.group") == F.col("final.group"),
                F.array(F.struct("first.group", "first.size", "first.keep", "continued")),
            ).otherwise(
                F.array(
                    F.struct("first.group", "first.size", "first.keep", "continued"),
                    F.struct("final.group", "final.size", "final.keep", F.lit(False).alias("continued")),
                )
            )
        ).alias("g"),
    ).select("in_range", F.col("g.group").alias("in_group"), "g.size", "g.keep", "g.continued")
    by_place = Window.orderBy("in_range", "in_group")
    chained = both.withColumn(
        "chain",
        F.sum((~F.col("continued")).cast("int")).over(
            by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    chain = Window.partitionBy("chain")
    return chained.select(
        "in_range",
        "in_group",
        "continued",
        F.sum("size").over(chain).alias("chain_size"),
        F.min(F.struct("in_range", "in_group", "keep")).over(chain)["keep"].alias("chain_keep"),
    )
