"""Exact top-k search by integer inner product over KD-trees.

Vectors are quantised to whole numbers.  They are dealt into shards of bounded size; each shard
becomes one KD-tree of median splits with tight bounding boxes.  A block of queries meets every
shard, one block and one shard at a time: for each query the boxes are visited best first, by the
largest inner product a box allows, until no box can reach the k-th best score.  Each block starts
with another shard and goes on in rounds, each over ``GROWTH`` times as many shards as all before.
After a round only the k best of each query are kept, and the k-th score goes into the next one.

Vectors that are null or hold a null or a non-finite component take no part, nor do queries like
that.  Only vectors of one length are compared with each other.  Repeated rows are candidates of
their own, also to each other; ties go to the smaller identifier (null last).  An empty table gives
an empty result.  Extra columns are ignored.

Scores are exact: the largest component of the table, found once, decides whether products are summed
as floating point numbers (below 2^53 all of them are exact) or as 64-bit whole numbers.  Vectors
whose products do not fit those either are refused with an error.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

SCALE = 64
SHARD_ROWS = 2_048
BLOCK_ROWS = 2_048
GROWTH = 3
LEAF_ROWS = 64


STATE = ("query_row", "query_id", "row", "id", "score")


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, ints): whole-number vectors of the rows that take part."""
    x = F.col("embedding")
    wide = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    used = vectors.where(x.isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(x) > 0))
    return used.select("vec_id", wide.alias("ints")).withColumn("row", F.monotonically_increasing_id())


class Tree:
    """A KD-tree over whole-number vectors, as arrays: nodes with boxes, leaves as ranges of rows."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.sons: list[tuple[int, int] | None] = []
        todo = [(0, len(points), -1, 0)] if len(points) else []
        while todo:
            begin, end, parent, side = todo.pop()
            rows = points[self.order[begin:end]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            number = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((begin, end))
            self.sons.append(None)
            if parent >= 0:
                first, second = self.sons[parent] or (-1, -1)
                self.sons[parent] = (number, second) if side == 0 else (first, number)
            widest = int((high - low).argmax())
            if end - begin > leaf_rows and high[widest] > low[widest]:
                middle = (end - begin) // 2
                part = np.argpartition(rows[:, widest], middle)
                self.order[begin:end] = self.order[begin:end][part]
                todo += [(begin, begin + middle, number, 0), (begin + middle, end, number, 1)]
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product with each query that each node's box allows."""
        low, high = np.array(self.low), np.array(self.high)
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(
    tree: Tree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best candidates of the tree: (query number, positions, scores).

    ``floor`` is a score that k candidates elsewhere are known to reach; only what reaches it too
    is returned.  ``own`` is the row number of the query itself.
    """
    bounds = tree.bounds(queries)
    for number, query in enumerate(queries):
        limit = floor[number]
        best_at, best = np.zeros(0, np.int64), np.zeros(0, tree.points.dtype)
        queue = [(-bounds[number, 0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < limit:
                break
            if (sons := tree.sons[node]) is not None:
                for son in sons:
                    if bounds[number, son] >= limit:
                        heapq.heappush(queue, (-bounds[number, son], son))
                continue
            begin, end = tree.span[node]
            scores = tree.points[begin:end] @ query
            near = np.flatnonzero(scores >= limit) + begin
            near = near[rows[near] != own[number]]
            if near.size:
                best_at = np.concatenate([best_at, near])
                best = np.concatenate([best, scores[near - begin]])
                if len(best) > k:
                    first = np.lexsort((ids[best_at], -best))[:k]
                    best_at, best = best_at[first], best[first]
                if len(best) == k:
                    limit = max(limit, best.min())
        if best_at.size:
            yield number, best_at, best


LOWEST = -(2**63)
EXACT_FLOAT, EXACT_WHOLE = 2**53, 2**63


def exact_type(vectors: DataFrame) -> type:
    """The number type in which all inner products of ``vectors`` are exact."""
    found = vectors.agg(
        F.max(F.array_max("ints")).alias("high"), F.min(F.array_min("ints")).alias("low"), F.max(F.size("ints")).alias("size")
    ).first()
    largest = max(abs(found["high"] or 0), abs(found["low"] or 0))
    # No sum of products, nor any part of it, is larger.
    most = largest * largest * (found["size"] or 0)
    if most >= EXACT_WHOLE:
        raise ValueError(f"components up to {largest}: inner products do not fit 64-bit numbers")
    return np.float64 if most < EXACT_FLOAT else np.int64


def rounds(shards: int) -> list[tuple[int, int]]:
    """Ranges of shard distances, each ``GROWTH`` times as long as all before it."""
    ends = [0, 1]
    while ends[-1] < shards:
        ends.append(min(shards, ends[-1] * (1 + GROWTH)))
    return list(itertools.pairwise(ends))


def met(places: DataFrame, other: str, others: int, shards: int, low: int, high: int) -> DataFrame:
    """Rows that have a ``shard`` or a ``block``, once for each ``other`` they meet in a round.

    A block meets the shards at distances from ``low`` to below ``high`` after its own number.
    """
    if other == "shard":
        numbers = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda d: F.pmod(F.col("block") + d, F.lit(shards)))
    else:
        every = F.sequence(F.lit(0), F.lit(others - 1))
        numbers = F.filter(every, lambda b: F.pmod(F.col("shard") - b, F.lit(shards)).between(low, high - 1))
    return places.withColumn(other, F.explode(numbers.cast("array<int>")))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` best other rows.

    Both have (row, vec_id, ints) as ``quantised`` gives; rows with the same ``row`` are the same.
    """
    kind = exact_type(vectors)
    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit("query")), F.lit(blocks)).cast("int")
    # A missing identifier comes after all others.
    number = F.coalesce(F.col("vec_id").cast("bigint"), F.lit(2**63 - 1))
    length = F.size("ints").alias("length")
    candidates = vectors.select(length, shard.alias("shard"), "row", number.alias("id"), "ints")
    asked = cut_lineage(queries.select(length, block.alias("block"), "row", number.alias("id"), "ints"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {name: [np.zeros(0, np.int64)] for name in STATE}
        if len(left) and len(right):
            tree = Tree(np.array(left["ints"].tolist(), kind))
            ids, rows = left["id"].to_numpy()[tree.order], left["row"].to_numpy()[tree.order]
            own, own_id = right["row"].to_numpy(), right["id"].to_numpy()
            points = np.array(right["ints"].tolist(), kind)
            for query, at, scores in search(tree, ids, rows, points, own, right["floor"].to_numpy(kind), k):
                parts = (np.full(len(at), own[query]), np.full(len(at), own_id[query]), rows[at], ids[at], scores)
                for name, part in zip(STATE, parts, strict=True):
                    found[name].append(part.astype(np.int64))
        return pd.DataFrame({name: np.concatenate(parts) for name, parts in found.items()})

    schema = ", ".join(f"{name} bigint" for name in STATE)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    nothing = F.lit(LOWEST).cast("bigint")
    ranked = None
    for low, high in rounds(shards):
        known = asked.withColumn("floor", nothing)
        if ranked is not None:
            kth = ranked.where(F.col("rank") == k).select(
                F.col("query_row").alias("row"), F.col("score").alias("floor")
            )
            known = asked.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", nothing))
        left = met(candidates, "block", blocks, shards, low, high).groupBy("length", "shard", "block")
        right = met(known, "shard", shards, shards, low, high).groupBy("length", "shard", "block")
        found = left.cogroup(right).applyInPandas(run, schema)
        if ranked is not None:
            found = found.unionByName(ranked.select(*STATE))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if high < shards:
            ranked = cut_lineage(ranked)

    def restored(column: str):
        return F.when(F.col(column) < 2**63 - 1, F.col(column))

    return ranked.select(
        restored("query_id").alias("query_id"), "rank", restored("id").alias("vec_id"), "score"
    )
