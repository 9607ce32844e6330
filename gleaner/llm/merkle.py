"""Merkle manifest of a dataset, and proofs of many leaves at once by octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each written as byte count, colon and value, or as
a dash if null.  Leaves of one language, ascending by identifier, form a tree: each two consecutive
nodes become the hash of their digests, and an odd last node the hash of its own.  The subroots, by
language, form a tree of the same kind, which ends in the root.  Digests are hashed as lowercase
hexadecimal text.

The trees are built in blocks of ``BLOCK`` nodes, as many rounds of blocks as the longest tree
needs, so no task holds a whole tree.  All nodes stay in a table, the manifest.

For proofs the leaves lie in partitions of at most ``BLOCK`` neighbours.  A partition works out which
nodes it cannot derive from its own leaves (the arms of an octopus: the siblings on the way up that
no other leaf of it covers), each once however many proofs need it.  All partitions fetch these
coordinates in one join with the manifest.  Then a partition derives all nodes on its paths once and
reads the siblings of each leaf from them.

Null fields are dashes; null languages form the first tree, null identifiers come first in theirs.
Repeated rows are leaves of their own, in any order, since they are equal; rows with the same
language and identifier but other fields are in the order of their leaf hashes.  Very long texts
are hashed whole.  An empty table has no root and no proofs.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from binascii import hexlify, unhexlify
from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small, cut_lineage

BLOCK_LEVELS = 12
BLOCK = 1 << BLOCK_LEVELS
TOP = -1  # number of the tree of subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree bigint, level int, place bigint, digest binary"


def field(value: Column) -> Column:
    text = value.cast("string")
    written = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(written, F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest (32 bytes) of the fields in their order."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], position: str) -> DataFrame:
    """Stored ``rows`` with their place in the ``order`` within their ``group``, from 0.

    Rows are laid out by ranges over (group, order), so a group that holds most rows is spread; only
    the counts of each group and task are summed up.
    """
    laid = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = cut_lineage(laid.withColumns({"_part": F.spark_partition_id(), "_index": index}))
    ranges = stored.groupBy("_part", *group).agg(F.min("_index").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
    )
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]]
    return stored.join(broadcast_if_small(starts), same).select(
        *rows.columns, (F.col("_start") + F.col("_index")).alias(position)
    )


def parents(digests: list[bytes]) -> list[bytes]:
    """The next level; digests are hexadecimal."""
    pairs = [hexlify(sha256(a + b).digest()) for a, b in zip(digests[::2], digests[1::2], strict=False)]
    return pairs + ([hexlify(sha256(digests[-1]).digest())] if len(digests) % 2 else [])


def levels_above(width: int) -> int:
    """How many levels lie over the leaves of a tree."""
    return (width - 1).bit_length()


def build(leaves: DataFrame, longest: int) -> DataFrame:
    """All nodes (tree, level, place, digest) over ``leaves`` (tree, place, digest, width).

    ``width`` is the number of leaves of the tree, ``longest`` the largest of them.
    """
    rounds = max(1, math.ceil(levels_above(longest) / BLOCK_LEVELS))
    found = []
    rows = leaves.select("tree", "place", "digest", "width")
    for low in range(0, rounds * BLOCK_LEVELS, BLOCK_LEVELS):
        block = F.shiftright("place", BLOCK_LEVELS).alias("block")
        climbed = cut_lineage(rows.groupBy("tree", block).applyInPandas(climber(low), NODE + ", width bigint"))
        found.append(climbed.select("tree", "level", "place", "digest"))
        high = low + BLOCK_LEVELS
        rows = climbed.where((F.col("level") == high) & (F.col("width") > F.lit(2.0**high)))
        rows = rows.select("tree", "place", "digest", "width")
    return functools.reduce(DataFrame.unionAll, found)


def climber(low: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function that climbs from a block of nodes at level ``low`` to its top or the tree's.

    It returns the nodes above ``low``, and the leaves themselves too if ``low`` is 0.
    """

    def climb(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        tree, number, width = int(key[0]), int(key[1]), int(block["width"].iloc[0])
        nodes = [hexlify(d) for d in block["digest"]]
        levels = [(low, nodes)] if low == 0 else []
        for level in range(low + 1, min(low + BLOCK_LEVELS, levels_above(width)) + 1):
            nodes = parents(nodes)
            levels.append((level, nodes))
        first = number * BLOCK
        rows = [
            (tree, level, (first >> (level - low)) + at, unhexlify(digest), width)
            for level, digests in levels
            for at, digest in enumerate(digests)
        ]
        return pd.DataFrame(rows, columns=["tree", "level", "place", "digest", "width"])

    return climb


class Manifest:
    """Leaves with their places, and the table of all nodes.

    ``leaves``: (doc_id, tree, place, width, digest, other); ``nodes``: (tree, level, place, digest);
    ``trees``: how many subroots there are.
    """

    def __init__(self, docs: DataFrame, changed: Column | None = None, changes: Mapping[str, Column] | None = None):
        """``changed`` rows also get the leaf hash (``other``) that they have after ``changes``."""
        other = F.lit(None).cast("binary")
        if changed is not None:
            after = {c: F.col(c) for c in FIELDS} | dict(changes or {})
            other = F.when(changed, leaf_hash([after[c] for c in FIELDS]))
        own = [F.col(c) for c in FIELDS]
        hashed = cut_lineage(
            docs.select("doc_id", "lang", leaf_hash(own).alias("digest"), other.alias("other")).withColumn(
                "_row", F.monotonically_increasing_id()
            )
        )
        widths = cut_lineage(hashed.groupBy("lang").agg(F.count("*").alias("width")))
        trees = numbered(widths, [], ["lang"], "tree")
        places = numbered(hashed, ["lang"], ["doc_id", "digest", "_row"], "place").drop("_row")
        named = broadcast_if_small(trees.withColumnRenamed("lang", "_lang"))
        self.leaves = cut_lineage(
            places.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select(
                "doc_id", "tree", "place", "width", "digest", "other"
            )
        )
        size = widths.agg(F.count("*").alias("trees"), F.max("width").alias("longest")).first()
        self.trees = int(size["trees"])
        lower = build(self.leaves, int(size["longest"] or 1))
        tops = trees.select(F.col("tree").alias("t"), "width")
        level = F.when(F.col("width") > 1, F.length(F.bin(F.col("width") - 1))).otherwise(0)
        tops = broadcast_if_small(tops.select("t", level.alias("top")))
        subroots = lower.join(tops, (F.col("tree") == F.col("t")) & (F.col("level") == F.col("top")))
        upper = build(
            subroots.select(
                F.lit(TOP).cast("bigint").alias("tree"),
                F.col("tree").alias("place"),
                "digest",
                F.lit(self.trees).cast("bigint").alias("width"),
            ),
            self.trees or 1,
        )
        self.nodes = lower.unionAll(upper)


def missing(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The least (level, place) a holder of these leaves needs to derive the root."""
    known = np.unique(places)
    needed = []
    for level in range(levels_above(width)):
        sibling = known ^ 1
        lacking = sibling[(sibling < width) & ~np.isin(sibling, known)]
        needed += [(level, int(p)) for p in lacking]
        known = np.unique(known >> 1)
        width = (width + 1) // 2
    return needed


def derive(
    digests: dict[int, bytes], fetched: dict[tuple[int, int], bytes], width: int
) -> list[dict[int, bytes]]:
    """All nodes by level that follow from leaves and fetched nodes; digests are hexadecimal."""
    levels = []
    own = digests
    for level in range(levels_above(width)):
        known = own | {place: digest for (at, place), digest in fetched.items() if at == level}
        levels.append(known)
        own = {}
        for place in {p >> 1 for p in known}:
            both = known[2 * place] + known.get(2 * place + 1, b"")
            own[place] = hexlify(sha256(both).digest())
    return [*levels, own]


def siblings(levels: list[dict[int, bytes]], place: int, width: int) -> list[tuple[bytes, bool]]:
    """The siblings of a leaf up to the root, as (digest or empty, whether it stands left)."""
    path = []
    for level in range(levels_above(width)):
        path.append((levels[level].get(place ^ 1, b""), bool(place & 1)))
        place >>= 1
    return path


def fold(digest: bytes, path: list[tuple[bytes, bool]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for sibling, left in path:
        digest = hexlify(sha256(sibling + digest if left else digest + sibling).digest())
    return digest


PROOF = (
    "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def proofs(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``leaves``, by default all.

    A leaf with another digest (``other``) is folded from that one; it is verified if that leads to
    the root of the manifest.
    """
    leaves = manifest.leaves if leaves is None else leaves
    trees = manifest.trees
    summit = levels_above(trees) if trees else 0
    block = F.shiftright("place", BLOCK_LEVELS).alias("block")

    def wanted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, part = int(key[0]), int(key[1])
        width = int(rows["width"].iloc[0])
        coordinates = [(tree, *c) for c in missing(rows["place"].to_numpy(), width)]
        coordinates += [(TOP, *c) for c in missing(np.array([tree]), trees)]
        coordinates.append((TOP, summit, 0))
        out = pd.DataFrame(coordinates, columns=["n_tree", "n_level", "n_place"])
        out["p_tree"], out["p_block"] = tree, part
        return out

    asked = (
        leaves.select("tree", "place", "width")
        .groupBy("tree", block)
        .applyInPandas(wanted, "p_tree bigint, p_block bigint, n_tree bigint, n_level int, n_place bigint")
    )
    asked = broadcast_if_small(asked)
    here = (F.col("tree") == F.col("n_tree")) & (F.col("level") == F.col("n_level")) & (F.col("place") == F.col("n_place"))
    fetched = manifest.nodes.join(asked, here).select("p_tree", "p_block", "tree", "level", "place", "digest")

    def prove(key: tuple, own: pd.DataFrame, arms: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        width = int(own["width"].iloc[0]) if len(own) else 1
        lower: dict[tuple[int, int], bytes] = {}
        upper: dict[tuple[int, int], bytes] = {}
        for of, level, place, digest in zip(arms["tree"], arms["level"], arms["place"], arms["digest"], strict=True):
            (upper if of == TOP else lower)[int(level), int(place)] = hexlify(digest)
        digests = [hexlify(d) for d in own["digest"]]
        places = [int(p) for p in own["place"]]
        levels = derive(dict(zip(places, digests, strict=True)), lower, width)
        subroot = levels[-1][0] if len(own) else b""
        root = upper.pop((summit, 0))
        over = siblings(derive({tree: subroot}, upper, trees), tree, trees)
        rows = []
        for doc_id, place, digest, other in zip(own["doc_id"], places, digests, own["other"], strict=True):
            path = siblings(levels, place, width) + over
            given = digest if other is None else hexlify(other)
            folded = fold(given, path)
            proof = sha256(b"".join(sibling for sibling, _ in path)).hexdigest()
            rows.append((doc_id, digest.decode(), subroot.decode(), root.decode(), proof, folded.decode(), folded == root))
        names = ["doc_id", *(part.split(" ")[0] for part in PROOF.split(", "))]
        return pd.DataFrame(rows, columns=names)

    # As text, since a column with nulls would come as floating point numbers.
    own = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))
    left = own.groupBy("tree", block)
    right = fetched.groupBy("p_tree", "p_block")
    return left.cogroup(right).applyInPandas(prove, f"doc_id string, {PROOF}").withColumn(
        "doc_id", F.col("doc_id").cast(manifest.leaves.schema["doc_id"].dataType)
    )


def tampered(modulus: int = 7) -> tuple[Column, Column]:
    """Which rows are tampered with, and their number of characters then."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    return F.coalesce(chosen, F.lit(False)), F.col("n_chars").cast("decimal(20,0)") + 1

