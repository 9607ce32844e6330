"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` vectors, the smallest by a hash of the
vector): a node is split by k-means into up to ``BRANCH`` children until its share of the table is at most
``LEAF_ROWS`` rows or it holds too little of the sample.  Every row of the table is then put into the
leaf it comes to by the nearest centres.

A query walks the tree through a priority queue: the node with the nearest centre is opened first
and its children are queued, so leaves come up best bin first.  How many leaves each query visits is
calibrated: for ``CALIBRATION`` of the queries the exact neighbours among all rows are found, and the
visits are widened until the leaves visited hold ``RECALL`` of them.  All leaves hold all of them, so
this ends.

Queries and rows meet by leaf, in blocks of bounded size on both sides, so a leaf that holds most
rows or is visited by most queries is split.  Distances are exact, in double precision on the
original vectors.  Copies of one vector are at one distance and ties go to the smaller identifier,
so only the k + 1 copies with the smallest identifiers can be results; the others are left out of
the search, without an effect on it.

Vectors that are null, zero or empty or hold null or non-finite components take no part, nor do
queries like that.  Only vectors of one length are compared; a length that the sample lacks is one
leaf.  Repeated rows are candidates of their own, also to each other; a null identifier comes after
all others.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

SAMPLE_ROWS = 32_768
BRANCH = 12
LEAF_ROWS = 256
ITERATIONS = 12
CALIBRATION = 256
RECALL = 0.95
WIDER = 1.25
ROW_BLOCK = 4_096
QUERY_BLOCK = 1_024
LAST = 2**63 - 1  # stands for a missing identifier


def usable(vectors: DataFrame) -> DataFrame:
    """(row, id, vector, length) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    return vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(LAST)).alias("id"),
        x.alias("vector"),
        F.size(x).alias("length"),
    )


def points_by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, points) for each length of vectors in a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(np.concatenate([[0], ends]))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, values[(ends[rows] - length)[:, None] + np.arange(length)]


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, fast, with the rounding errors of a product."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.nan_to_num(np.maximum(far, 0), nan=np.inf, posinf=np.inf)


def k_means(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Up to ``k`` centres; seeds are drawn by their squared distance from those before."""
    centres = points[[random.integers(len(points))]]
    nearest = squared(points, centres)[:, 0]
    while len(centres) < k and nearest.max() > 1e-12:
        drawn = points[[random.choice(len(points), p=nearest / nearest.sum())]]
        centres = np.concatenate([centres, drawn])
        nearest = np.minimum(nearest, squared(points, drawn)[:, 0])
    for _ in range(ITERATIONS):
        nearest_at = squared(points, centres).argmin(axis=1)
        sizes = np.bincount(nearest_at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_at, points)
        moved = sums[sizes > 0] / sizes[sizes > 0, None]
        if moved.shape == centres.shape and np.allclose(moved, centres):
            break
        centres = moved
    return centres


class Tree:
    """A hierarchy of centres; ``sons`` of a node are empty in a leaf, ``leaf`` numbers the leaves."""

    def __init__(self, points: np.ndarray, rows_each: float, seed: int = 1):
        random = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [points.mean(axis=0)]
        self.sons: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        for node, own in enumerate(todo):
            sons = np.zeros(0, np.int64)
            parts = math.ceil(len(own) * rows_each / LEAF_ROWS)
            if parts > 1 and len(own) >= 2 * BRANCH:
                centres = k_means(points[own], min(parts, BRANCH), random)
                if len(centres) > 1:
                    sons = len(todo) + np.arange(len(centres))
                    nearest = squared(points[own], centres).argmin(axis=1)
                    self.centres += list(centres)
                    todo += [own[nearest == n] for n in range(len(centres))]
            self.sons.append(sons)
        self.matrix = np.array(self.centres)
        leaves = [n for n, sons in enumerate(self.sons) if not len(sons)]
        self.leaf = {node: number for number, node in enumerate(leaves)}

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down by the nearest centre of each node."""
        node = np.zeros(len(points), np.int64)
        open_nodes = [0]
        while open_nodes:
            sons = self.sons[at := open_nodes.pop()]
            here = np.flatnonzero(node == at)
            if len(sons) and here.size:
                node[here] = sons[squared(points[here], self.matrix[sons]).argmin(axis=1)]
                open_nodes += sons.tolist()
        return np.array([self.leaf[n] for n in node.tolist()], np.int64)

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            sons = self.sons[node]
            if not len(sons):
                yield self.leaf[node]
                continue
            far = ((self.matrix[sons] - query) ** 2).sum(axis=1)
            for distance, son in zip(far.tolist(), sons.tolist(), strict=True):
                heapq.heappush(queue, (distance, son))


def nearest(distances: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest (distance, identifier, row), in order; not of missing distances."""
    at = np.flatnonzero(~np.isnan(distances))
    if at.size > k:
        at = at[distances[at] <= np.partition(distances[at], k - 1)[k - 1]]
    return at[np.lexsort((rows[at], ids[at], distances[at]))[:k]]


def fit(rows: DataFrame, total: int) -> dict[int, Tree]:
    """A tree per length of vectors, from a bounded sample of ``rows``."""
    drawn = rows.orderBy(F.xxhash64("vector", "row")).limit(SAMPLE_ROWS).select("vector").toArrow()
    if not drawn.num_rows:
        return {}
    each = max(1.0, total / drawn.num_rows)
    return {length: Tree(points, each) for length, _, points in points_by_length(drawn.column("vector"))}


def indexed(rows: DataFrame, trees: Mapping[int, Tree]) -> DataFrame:
    """Every row with its ``leaf``."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    vector = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for length, at, points in points_by_length(batch.column("vector")):
                if length in shared.value:
                    leaf[at] = shared.value[length].place(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, f"row bigint, id bigint, vector {vector}, length int, leaf bigint")


def without_far_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k`` + 1 first: one may be the query's own row, and ties go to the first."""
    copies = Window.partitionBy("length", "leaf", "vector").orderBy("id", "row")
    return rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")


def exact_leaves(rows: DataFrame, queries: pa.Table, k: int) -> list[list[int]]:
    """For each of a few queries the leaves of its ``k`` nearest rows, by a pass over all rows."""
    asked = {length: (at, points) for length, at, points in points_by_length(queries.column("vector"))}
    own = queries.column("row").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: (np.zeros(0), np.zeros((0, 3), np.int64)) for at, _ in asked.values() for n in at.tolist()}
        for batch in batches:
            facts = np.stack([batch.column(c).to_numpy() for c in ("id", "row", "leaf")], axis=1)
            for length, at, points in points_by_length(batch.column("vector")):
                if length not in asked:
                    continue
                for number, far in zip(asked[length][0].tolist(), squared(asked[length][1], points), strict=True):
                    far[facts[at, 1] == own[number]] = np.nan
                    # Few rows of a batch are near enough to be looked at one by one.
                    near = nearest(far, facts[at, 0], facts[at, 1], k)
                    far = np.concatenate([best[number][0], far[near]])
                    both = np.concatenate([best[number][1], facts[at][near]])
                    first = nearest(far, both[:, 0], both[:, 1], k)
                    best[number] = (far[first], both[first])
        for number, (far, found) in best.items():
            names = {"id": found[:, 0], "row": found[:, 1], "leaf": found[:, 2], "far": far}
            columns = {"query": pa.array(np.full(len(far), number))} | {n: pa.array(c) for n, c in names.items()}
            yield pa.RecordBatch.from_pydict(columns)

    found = rows.mapInArrow(run, "query bigint, id bigint, row bigint, leaf bigint, far double")
    best = Window.partitionBy("query").orderBy("far", "id", "row")
    kept = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "leaf")
    leaves: list[list[int]] = [[] for _ in own]
    for r in kept.collect():  # k rows for each of a few queries
        leaves[r["query"]].append(r["leaf"])
    return leaves


def calibrated_visits(
    rows: DataFrame, queries: DataFrame, trees: Mapping[int, Tree], k: int, recall: float, drawn: int
) -> int:
    """How many leaves a query must visit to find ``recall`` of its neighbours, measured on some."""
    few = queries.orderBy(F.xxhash64("row", F.lit("calibration")), "row").limit(drawn).toArrow()
    if not few.num_rows:
        return 1
    leaves = exact_leaves(rows, few, k)
    wanted = []
    for length, at, points in points_by_length(few.column("vector")):
        for number, query in zip(at, points, strict=True):
            turn = {leaf: n for n, leaf in enumerate(trees[length].visits(query))} if length in trees else {0: 0}
            wanted += [turn[leaf] for leaf in leaves[number]]
    turns = np.array(wanted)
    visits = 1
    while turns.size and (turns < visits).mean() < recall:
        visits = max(visits + 1, math.ceil(visits * WIDER))
    return visits


def visited(queries: DataFrame, trees: Mapping[int, Tree], visits: int) -> DataFrame:
    """Each query once for each of the ``leaf`` numbers it visits."""
    shared = queries.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            leaves: list[int] = []
            for length, at, points in points_by_length(batch.column("vector")):
                for number, query in zip(at.tolist(), points, strict=True):
                    seen = shared.value[length].visits(query) if length in shared.value else iter([0])
                    ways = [leaf for _, leaf in zip(range(visits), seen, strict=False)]
                    row += [number] * len(ways)
                    leaves += ways
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int64())], names=[*batch.schema.names, "leaf"])

    vector = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"row bigint, id bigint, vector {vector}, length int, leaf bigint")


FOUND = ("query_row", "query_id", "row", "id", "score")


def comparer(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Compares a block of rows with a block of queries of the same leaf."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, np.int64)] for name in FOUND[:-1]}
        parts["score"] = [np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            ((_, _, points),) = points_by_length(rows.column("vector"))
            ((_, _, asked),) = points_by_length(queries.column("vector"))
            ids, numbers = rows.column("id").to_numpy(), rows.column("row").to_numpy()
            own, own_id = queries.column("row").to_numpy(), queries.column("id").to_numpy()
            for query, row, number in zip(asked, own, own_id, strict=True):
                far = np.sqrt(((points - query) ** 2).sum(axis=1))
                far[numbers == row] = np.nan
                best = nearest(far, ids, numbers, k)
                parts["query_row"].append(np.full(best.size, row))
                parts["query_id"].append(np.full(best.size, number))
                parts["row"].append(numbers[best])
                parts["id"].append(ids[best])
                parts["score"].append(far[best])
        return pa.table({name: np.concatenate(part) for name, part in parts.items()})

    return run


def nearest_neighbours(
    vectors: DataFrame,
    asked: str,
    k: int = 10,
    recall: float = RECALL,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``asked`` (SQL on ``id``) its ``k`` nearest.

    ``score`` is the Euclidean distance; results are among the leaves visited.
    """
    stored = cut_lineage(usable(vectors))
    total = stored.count()
    trees = fit(stored, total)
    rows = cut_lineage(without_far_copies(indexed(stored, trees), k))
    queries = cut_lineage(stored.where(asked).where(F.col("id") != LAST))
    visits = calibrated_visits(rows, queries, trees, k, recall, calibration)
    ways = cut_lineage(visited(queries, trees, visits))
    # One row per leaf: bounded by the sample, like the trees.
    leaf = ["length", "leaf"]
    row_blocks = rows.groupBy(*leaf).agg(F.ceil(F.count("*") / ROW_BLOCK).alias("row_blocks"))
    query_blocks = ways.groupBy(*leaf).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks"))
    blocks = F.broadcast(cut_lineage(row_blocks.join(query_blocks, leaf)))

    def dealt(side: DataFrame, name: str, other: str) -> DataFrame:
        """Each row in one block of its side, once for each block of the other side."""
        own = F.pmod(F.xxhash64("row"), F.col(f"{name}s")).alias(name)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)).alias(other)
        return side.join(blocks, leaf).select("row", "id", "vector", *leaf, own, every)

    key = [*leaf, "row_block", "query_block"]
    left = dealt(rows, "row_block", "query_block").groupBy(*key)
    right = dealt(ways, "query_block", "row_block").groupBy(*key)
    found = left.cogroup(right).applyInArrow(
        comparer(k), "query_row bigint, query_id bigint, row bigint, id bigint, score double"
    )
    best = Window.partitionBy("query_row").orderBy("score", "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") < LAST, F.col("id")).alias("vec_id"), "score"
    )
