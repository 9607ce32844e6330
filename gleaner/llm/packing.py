"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most ``max_tokens`` ids.  Only the histogram of piece lengths
(``max_tokens`` bins at most, whatever the data) reaches the driver.  There lengths are placed
longest first: each goes to the packs with the most room, and packs that look alike are one
pattern with a count.  The placements, a table bounded by the number of bins, are joined back to
the pieces by length and rank.

Null and empty texts are one piece that holds the end id only.  Repeated rows are documents of
their own.  Ties in length are broken by the order of the stored pieces, which never changes what
a sequence's lengths are.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import SLICE_CHARS, ByteBPE, tokenizer
from gleaner.llm.common import bound_arrow_batches, slices
from gleaner.session import cut_lineage

MAX_TOKENS = 1024
END_ID = 0
ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 64  # also a small table's most frequent length is ranked in several tasks


# Fixed value: how the byte-level vocabulary cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class CompiledBPE:
    """The same ids as ``ByteBPE`` from a compiled library, several times faster."""

    def __init__(self, exact: ByteBPE):
        self.exact = exact
        special = {text: int.from_bytes(ids, "little") for text, ids in exact.special.items()}
        ranks = {s: i for i, s in enumerate(exact.strings) if s and i not in special.values()}
        self.library = tiktoken.Encoding(
            "packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            return self.library.encode_to_numpy(text, allowed_special="all").tobytes()
        except ValueError:  # white space without end is too deep for its pattern engine
            return self.exact.encode(text)


def cut_pieces(
    docs: DataFrame,
    definition: Broadcast[bytes],
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids, then the end id, in pieces."""
    bound_arrow_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = CompiledBPE(tokenizer(definition))
        for batch in batches:
            for part, texts in slices(batch, "_text", SLICE_CHARS):
                row: list[int] = []
                starts: list[int] = []
                pieces: list[bytes] = []
                totals: list[int] = []
                for number, text in enumerate(texts):
                    ids = bpe.encode(text) + end
                    for at in range(0, len(ids), step):
                        row.append(number)
                        starts.append(at // 4)
                        pieces.append(ids[at : at + step])
                        totals.append(len(ids) // 4)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                        "start": pa.array(starts, pa.int64()),
                        "length": pa.array([len(p) // 4 for p in pieces], pa.int64()),
                        "ids": pa.array(pieces, pa.binary()),
                        "doc_tokens": pa.array(totals, pa.int64()),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint"
    )


def place_lengths(histogram: Mapping[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of all lengths.

    A pattern is a run of alike sequences: (room, first sequence, count).  Lengths go longest
    first to the pattern with the most room; a pattern that is only filled in part is split.
    """
    placements = []
    patterns: list[tuple[int, int, int]] = []  # heap: least used first, so most room first
    sequences = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if patterns and patterns[0][0] + length <= max_tokens:
                used, first, count = heapq.heappop(patterns)
            else:
                used, first, count = 0, sequences, -(-left // (max_tokens // length))
                sequences += count
            taken = min(count, left)
            placements.append((length, rank, taken, first, used))
            heapq.heappush(patterns, (used + length, first, taken))
            if taken < count:
                heapq.heappush(patterns, (used, first + taken, count - taken))
            rank += taken
            left -= taken
    return placements


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    length: str = "length",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths must lie in 1 to ``max_tokens``.

    Ranks within a length come from counts of (length, bucket) and a window in each bucket, so a
    length that most pieces have is spread over many tasks.
    """
    spark = pieces.sparkSession
    taken = {"sequence_id", "offset", "_piece", "_bucket", "_rank"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns have names of new columns: {sorted(taken)}")
    stored = cut_lineage(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    rows = stored.count()
    buckets = max(LEAST_BUCKETS, -(-rows // rows_per_bucket))
    bucket: Column = F.pmod(F.xxhash64("_piece"), F.lit(buckets)).cast("int")
    numbered = stored.withColumn("_bucket", bucket)
    counts = numbered.groupBy(F.col(length).alias("_length"), F.col("_bucket").alias("_b")).count()
    before = Window.partitionBy("_length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(
        counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    )
    histogram = {
        int(r["_length"]): int(r["n"])
        for r in counts.groupBy("_length").agg(F.sum("count").alias("n")).collect()
    }
    places = spark.createDataFrame(
        place_lengths(histogram, max_tokens),
        "_l bigint, _from bigint, _count bigint, _first bigint, _offset bigint",
    )
    within = Window.partitionBy(length, "_bucket").orderBy("_piece")
    ranked = (
        numbered.withColumn("_row", F.row_number().over(within) - 1)
        .join(counts.drop("count"), (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_rank", F.col("_before") + F.col("_row"))
    )
    placed = ranked.join(
        F.broadcast(places),
        (F.col(length) == F.col("_l"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_from") + F.col("_count")),
    )
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )
