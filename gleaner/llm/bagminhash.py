"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its ``shingle`` consecutive words (lower case, letters, numbers and
underscores).  Each shingle with weight w owns Poisson processes over the weight axis [0, w), cut
into the intervals [0,1), [1,2), [2,4), [4,8) and so on.  An interval's first point comes from one
process; then the interval is halved: the point falls into one half, the other half goes on with a
process of its own, down to intervals of length 1.  All is drawn from hashes of shingle and
interval, so texts that share weight share points.  Every point picks a component of the signature
and the earliest point wins it.  Two signatures agree in a component with a probability equal to
the weighted Jaccard similarity of the multisets.

Texts with equal words are one node from then on.  Bands of the signature give buckets.  In rounds
all nodes of a bucket are verified against one leader (linear in the bucket), and what is linked
becomes one component; at last the pairs across the components that a bucket still holds are
verified too.  So no link that the bands find is lost, and groups of near copies never become all
pairs; only a crowd in one bucket whose texts are not linked is compared pair by pair.
Verification compares the exact multisets.  Classes are connected components of the links.

Null texts and texts without words are classes of their own.  Texts with fewer words than a
shingle are one shingle.  Repeated rows share a class.  Ties for the row to stay go to the
smallest identifier (null last), then to the first stored row.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_arrow_batches, claim, keeps, slices
from gleaner.llm.graphs import components
from gleaner.session import broadcast_if_small, cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
FEW_PAIRS = 10_000  # fewer pairs than these are compared at once
BLOCK_ROWS, MANY_BLOCKS, LARGEST_BLOCK = 64, 32, 1_024
PACK_ROWS = 500
COLUMNS = 8_192
CACHED_WORDS = 60_000
SLICE_CHARS = 200_000
POINTS = 7  # first draw: so many points for each component of the signature

words_of = re.compile(r"\w+").findall

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of recent words."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


_hashes = WordHashes()
keeps("bagminhash", _hashes.clear)


def shingles(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, ascending, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    total = hashed[: len(words) - size + 1].copy()
    for place in range(1, size):
        total = mix(total + GOLDEN) + hashed[place : len(words) - size + 1 + place]
    return np.unique(mix(total), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def _uniform(points: np.ndarray) -> np.ndarray:
    return ((mix(points + GOLDEN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _waits(points: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    return -np.log(_uniform(points)) / rate


class Signatures:
    """For many multisets at once: earliest point of each component, and its identity."""

    def __init__(self, texts: int, size: int):
        self.size = size
        self.times = np.full(texts * size, np.inf)
        self.points = np.zeros(texts * size, np.uint64)

    def offer(self, owner: np.ndarray, times: np.ndarray, points: np.ndarray) -> None:
        place = (points >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)
        place = owner * self.size + place.astype(np.int64)
        np.minimum.at(self.times, place, times)
        won = times == self.times[place]
        self.points[place[won]] = points[won]

    def limits(self) -> np.ndarray:
        """Per multiset the time after which no point can win any more."""
        return self.times.reshape(-1, self.size).max(axis=1)


def _leaf(element: np.ndarray, low: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Identity of point number ``turn`` of the unit interval at ``low``."""
    return mix(element + low.astype(np.uint64) * GOLDEN + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _inner(element: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Identity of the first point of a longer interval."""
    return mix(mix(element ^ (low.astype(np.uint64) * GOLDEN)) + width.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def signatures(multisets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures of multisets with whole-number weights: one row of winners each."""
    made = Signatures(len(multisets), size)
    counts = np.array([len(e) for e, _ in multisets], np.int64)
    if not counts.sum():
        return made.points.reshape(-1, size)
    element = np.concatenate([e for e, _ in multisets])
    weight = np.concatenate([w for _, w in multisets])
    owner = np.repeat(np.arange(len(multisets)), counts)
    at = np.zeros(len(element), np.int64)
    inner: list[tuple[np.ndarray, ...]] = []
    low = 1
    elements, owners = element, owner
    while (more := np.flatnonzero(weight > low)).size:
        lows = np.full(len(more), low, np.int64)
        if low == 1:
            element, owner = np.concatenate([element, elements[more]]), np.concatenate([owner, owners[more]])
            at = np.concatenate([at, lows])
        else:
            point = _inner(elements[more], lows, lows)
            inner.append((owners[more], elements[more], lows, lows, weight[more], _waits(point, lows), point))
        low *= 2
    nodes = tuple(np.concatenate(x) for x in zip(*inner, strict=True)) if inner else None
    # Many points of a unit interval at once, so that a short text needs few rounds too.
    turns = np.maximum(1, -(-POINTS * size // np.maximum(1, counts)))[owner]
    starts = np.cumsum(turns) - turns
    each = np.repeat(np.arange(len(element)), turns)
    number = np.arange(int(turns.sum())) - starts[each]
    point = _leaf(element[each], at[each], number)
    waits = np.cumsum(_waits(point, 1.0))
    before = np.where(starts > 0, waits[starts - 1], 0.0)
    made.offer(owner[each], waits - before[each], point)
    time, turn = waits[starts + turns - 1] - before, turns
    while True:
        limit = made.limits()
        alive = time < limit[owner]
        owner, element, at, time, turn = (x[alive] for x in (owner, element, at, time, turn))
        if nodes is not None:
            nodes, ready = _halve(made, nodes, limit)
            owner, element, at, time, turn = (
                np.concatenate(x) for x in zip((owner, element, at, time, turn), ready, strict=True)
            )
        if len(element):
            point = _leaf(element, at, turn)
            time = time + _waits(point, 1.0)
            made.offer(owner, time, point)
            turn = turn + 1
        elif nodes is None:
            return made.points.reshape(-1, size)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    return signatures([(elements, weights)], size)[0]


def _halve(made: Signatures, nodes: tuple[np.ndarray, ...], limit: np.ndarray) -> tuple[tuple | None, tuple]:
    """Offer the first points of longer intervals and halve those; unit intervals are returned."""
    early = nodes[5] < limit[nodes[0]]
    owner, element, low, width, weight, time, point = (x[early] for x in nodes)
    covered = low + width <= weight
    made.offer(owner[covered], time[covered], point[covered])
    half = width // 2
    upper = (mix(point + np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(63)).astype(bool)
    parts = []
    for high in (False, True):
        start = low + half * high
        inherits = upper == high
        own = np.where(half == 1, _leaf(element, start, np.zeros_like(start)), _inner(element, start, half))
        later = np.where(inherits, time, time + _waits(own, half))
        parts.append((owner, element, start, half, weight, later, np.where(inherits, point, own)))
    halves = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    used = halves[2] < halves[4]
    unit, longer = used & (halves[3] == 1), used & (halves[3] > 1)
    owner, element, low, _, _, time, point = (x[unit] for x in halves)
    made.offer(owner, time, point)
    ready = (owner, element, low, time, np.ones(len(owner), np.int64))
    return (tuple(x[longer] for x in halves) if longer.any() else None), ready


def bands_of(points: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    key = np.arange(bands, dtype=np.uint64) * GOLDEN
    for row in points.reshape(bands, rows).T:
        key = mix(key + row)
    return key.view(np.int64)


def signed(docs: DataFrame, keep: Sequence[str], bands: int, rows: int, size: int) -> DataFrame:
    """``keep`` columns (text among them), digest of the words, number of shingles, band keys."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_CHARS):
                digests, multisets = [], []
                for text in texts:
                    words = words_of((text or "").lower())
                    plain = " ".join(words)
                    digests.append(hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=16).digest() if words else None)
                    multisets.append(shingles(words, size))
                signed_rows = signatures(multisets, bands * rows)
                keys = [
                    bands_of(points, bands, rows) if digest else None
                    for points, digest in zip(signed_rows, digests, strict=True)
                ]
                totals = [int(counts.sum()) for _, counts in multisets]
                yield pa.RecordBatch.from_pydict(
                    {c: part.column(c) for c in keep}
                    | {
                        "digest": pa.array(digests, pa.binary()),
                        "total": pa.array(totals, pa.int64()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep).mapInArrow(
        run, f"{kept}, digest binary, total bigint, keys array<bigint>"
    )


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough; ``texts`` has (row, text)."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    used = texts.join(broadcast_if_small(ends), "row", "left_semi")
    joined = pairs.join(used.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(
        used.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        last, multiset = None, None  # pairs of one leader tend to follow each other
        for batch in batches:
            kept: tuple[list, list] = ([], [])
            for a, b, text_a, text_b in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
                if b.as_py() != last:
                    last, multiset = b.as_py(), shingles(words_of(text_b.as_py().lower()), size)
                if similarity(shingles(words_of(text_a.as_py().lower()), size), multiset) >= threshold:
                    kept[0].append(a.as_py())
                    kept[1].append(last)
            yield pa.RecordBatch.from_pydict({"u": pa.array(kept[0], pa.int64()), "v": pa.array(kept[1], pa.int64())})

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "u bigint, v bigint")


def near_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row per row of ``docs``.

    ``class_id`` is the identifier of the row that stays.
    """
    return _classified(docs, ["doc_id", "text"], threshold, bands, rows, size)[1].drop("row")


def survivors(
    docs: DataFrame,
    keep: Sequence[str],
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """The ``keep`` columns of one row per class."""
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    stored, classes = _classified(docs, columns, threshold, bands, rows, size)
    dropped = broadcast_if_small(classes.where("NOT kept").select("row"))
    return stored.join(dropped, "row", "left_anti").select(*keep)


def _classified(
    docs: DataFrame, columns: Sequence[str], threshold: float, bands: int, rows: int, size: int
) -> tuple[DataFrame, DataFrame]:
    """The stored rows with their number, and (doc_id, class_id, class_size, kept, row)."""
    clash = {"digest", "total", "keys", "row"} & set(columns)
    if clash:
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    numbered = signed(docs, columns, bands, rows, size)
    stored = cut_lineage(numbered.withColumn("row", F.monotonically_increasing_id()))
    texts = stored.select("row", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = cut_lineage(
        stored.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"),
            F.count(F.lit(1)).alias("copies"),
            F.min(order).alias("first"),
            F.first("total").alias("total"),
            F.first("keys").alias("keys"),
        )
    )
    found = linked_components(nodes, texts, threshold, size)
    named = nodes.join(found, "node", "left").select(
        "digest", "copies", "first", F.coalesce("component", "node").alias("component")
    )
    named = cut_lineage(named)
    classes = named.groupBy("component").agg(F.sum("copies").alias("class_size"), F.min("first").alias("keeper"))
    of_digest = named.select("digest", "component").join(classes, "component").drop("component")
    classified = stored.select("doc_id", "row", "digest").join(of_digest, "digest", "left").select(
        "doc_id",
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("keeper.row") == F.col("row"), F.lit(True)).alias("kept"),
        "row",
    )
    return stored, classified


def linked_components(nodes: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(node, component) of all nodes with verified links.

    In each round every bucket that still holds several components gets a leader, at first its
    smallest node, then one drawn by a hash, and all other components' nodes in it are compared
    with the leader: linear work.  When a round no longer halves the pairs across components,
    those that are left are compared in blocks, so that no link is lost.
    """
    placed = nodes.select("node", "total", F.explode("keys").alias("key"))
    often = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = cut_lineage(placed.join(often, "key"))
    found = cut_lineage(nodes.select("node", F.col("node").alias("component")).where("false"))
    before = None
    turn = 0
    while True:
        known = mixed_buckets(shared, found)
        left = pairs_left(known)
        if not left:
            return found
        last = before is not None and 2 * left > before
        if last or left < FEW_PAIRS:
            links = links_in_blocks(known, texts, threshold, size)
            last = True
        else:
            links = verified(cut_lineage(pairs_with_leaders(known, threshold, turn)), texts, threshold, size)
        links = cut_lineage(links)
        if not links.isEmpty():
            contracted = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
            found = cut_lineage(components(contracted.unionAll(links)))
        if last:
            return found
        before, turn = left, turn + 1


def mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, total, component) of all buckets with several components."""
    known = shared.join(found, "node", "left").select(
        "key", "node", "total", F.coalesce("component", "node").alias("component")
    )
    known = cut_lineage(known)
    mixed = known.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h")
    return cut_lineage(known.join(mixed.select("key"), "key"))


def pairs_left(known: DataFrame) -> int:
    """How many pairs of nodes of different components share a bucket, counted per bucket."""
    each = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return int(keys.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def _fits(threshold: float) -> Column:
    """Multisets of too different sizes cannot be similar enough."""
    return F.least("total", "other_total") >= F.lit(threshold) * F.greatest("total", "other_total")


def pairs_with_leaders(known: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (a, b) of each node and its buckets' leaders from other components."""
    draw = F.xxhash64("node", "key", F.lit(turn)) if turn else F.col("node")
    leaders = known.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "node", "total", "component")).alias("l"))
    leaders = leaders.select(
        "key", F.col("l.node").alias("other"), F.col("l.total").alias("other_total"), F.col("l.component").alias("with")
    )
    pairs = known.join(leaders, "key").where((F.col("component") != F.col("with")) & _fits(threshold))
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def multiset_tokens(rows: DataFrame, size: int) -> DataFrame:
    """(node, cluster, component, tokens): one token for each time a shingle occurs.

    Numbered occurrences turn a multiset into a set of tokens with the same similarities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        for batch in batches:
            tokens = []
            for text in batch.column("text"):
                elements, counts = shingles(words_of(text.as_py().lower()), size)
                starts = np.cumsum(counts) - counts
                turn = np.arange(int(counts.sum())) - np.repeat(starts, counts)
                tokens.append(mix(np.repeat(elements, counts) + turn.astype(np.uint64) * GOLDEN).tobytes())
            kept = {c: batch.column(c) for c in ("node", "cluster", "component")}
            yield pa.RecordBatch.from_pydict(kept | {"tokens": pa.array(tokens, pa.binary())})

    columns = rows.select("node", "cluster", "component", "text")
    return columns.mapInArrow(run, "node bigint, cluster bigint, component bigint, tokens binary")


def linked_in_block(x: pd.DataFrame, y: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links between nodes of ``x`` and ``y`` that join different components, a spanning set.

    Shared tokens are counted for all pairs at once by products of incidence matrices.
    """
    same = x is y
    sides = [x] if same else [x, y]
    if len({c for side in sides for c in side["component"]}) < 2:
        return []
    arrays = [[np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in sides]
    sizes = [np.array([len(a) for a in arrays[0]]), np.array([len(a) for a in arrays[-1]])]
    token, number = np.unique(np.concatenate([a for side in arrays for a in side]), return_inverse=True)
    number_of = np.bincount(number)
    column = np.cumsum(number_of > 1) - 1
    used = number_of[number] > 1
    owner = np.repeat(np.arange(sum(map(len, arrays))), np.concatenate([np.array([len(a) for a in side]) for side in arrays]))
    owner, column = owner[used], column[number[used]]
    width = int(column.max()) + 1 if column.size else 0
    rows = sum(map(len, arrays))
    shared = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    for low in range(0, width, COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        matrix = np.zeros((rows, min(COLUMNS, width - low)), np.float32)
        matrix[owner[here], column[here] - low] = 1
        shared += matrix[: len(sizes[0])] @ (matrix if same else matrix[len(sizes[0]) :]).T
    total = sizes[0][:, None] + sizes[1][None, :] - shared
    a, b = np.nonzero((shared >= threshold * total) & (total > 0))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    links = []
    first, second = x["component"].to_numpy(), y["component"].to_numpy()
    nodes = x["node"].to_numpy(), y["node"].to_numpy()
    for i, j in zip(a, b, strict=True):
        u, v = root(int(first[i])), root(int(second[j]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            links.append((int(nodes[0][i]), int(nodes[1][j])))
    return links


def links_in_blocks(known: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (u, v) across the components of each cluster of buckets that share nodes.

    A cluster is cut into blocks of nodes; every two blocks meet in one task, which returns the
    links it needs to join components and no list of pairs.  Small clusters share tasks.
    """
    firsts = known.groupBy("key").agg(F.min("node").alias("v"))
    stars = known.join(firsts, "key").select(F.col("node").alias("u"), "v")
    clusters = components(stars).withColumnRenamed("component", "cluster")
    members = cut_lineage(known.select("node", "component").distinct().join(clusters, "node"))
    counts = cut_lineage(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    wanted = broadcast_if_small(members.select(F.col("node").alias("row")))
    used = texts.join(wanted, "row", "left_semi").select(F.col("row").alias("node"), "text")
    tokens = cut_lineage(multiset_tokens(members.join(used, "node"), size))
    few = F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(MANY_BLOCKS))
    blocks = F.greatest(few, F.ceil(F.col("n") / LARGEST_BLOCK)).cast("int")
    packs = max(1, members.count() // PACK_ROWS)
    cut = tokens.join(counts, "cluster").withColumn("blocks", blocks).withColumns(
        {
            "block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"),
            # Clusters of one block are dealt into packs.
            "pack": F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(
                -1 - F.pmod(F.xxhash64("cluster"), F.lit(packs))
            ),
        }
    )
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pack", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "block", "cluster", "node", "component", "tokens",
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, cluster in rows.groupby("cluster", sort=False):
            if key[1] == key[2]:
                links += linked_in_block(cluster, cluster, threshold)
            else:
                x, y = cluster[cluster["block"] == key[1]], cluster[cluster["block"] == key[2]]
                if len(x) and len(y):
                    links += linked_in_block(x, y, threshold)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return met.groupBy("pack", "lo", "hi").applyInPandas(run, "u bigint, v bigint")
