"""Exact and near duplicates.

Every item counts as a possible original, whether it was rejected or not, so both lookups are
joins over (id, ts, key) rows and never depend on earlier decisions.  An item's original is
looked up among the items before it, in the order (ts, id).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.operators.ordered import earliest_at_or_after
from gleaner.session import by_shuffle, cut_lineage, with_keys_of

# Six blocks of 64 bits; three flipped bits leave at least three blocks untouched, so two near
# hashes agree on all bits of at least one of the twenty block triples (31 to 33 bits each).
_BLOCK_BITS = (11, 11, 11, 11, 10, 10)
_BLOCKS_KEPT = len(_BLOCK_BITS) - fixed.NEAR_DISTANCE

# Triples shared by more hashes than this are not compared pair by pair; see ``_near_in_crowds``.
CROWDED_TRIPLE = 256


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _triple_masks() -> list[int]:
    masks, shift = [], 0
    for size in _BLOCK_BITS:
        masks.append(((1 << size) - 1) << shift)
        shift += size
    return [_signed(sum(chosen)) for chosen in combinations(masks, _BLOCKS_KEPT)]


def _mask_array() -> Column:
    return F.array(*map(F.lit, _triple_masks())).cast("array<bigint>")


def _flipped(value: Column, bit: Column) -> Column:
    """``value`` with one bit changed; bit 64 stands for none."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return F.when(bit < 64, value.bitwiseXOR(mask)).otherwise(value)


def _within_one(simhash: str) -> Column:
    """Each of the 65 values at most one bit away, one per row."""
    bits = F.sequence(F.lit(0), F.lit(64))
    return F.explode(F.transform(bits, lambda bit: _flipped(F.col(simhash), bit)))


def _originals_by_key(
    items: DataFrame, key: str, days: int, asked: DataFrame | None = None
) -> DataFrame:
    """(id, original) of items with an earlier item of the same key within ``days``."""
    if asked is not None:
        # Of a large index only the rows that share a key with what is asked are looked at.
        items = with_keys_of(items.select(key, "ts", "id"), asked, [key])
    repeated = by_shuffle(items.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key))
    # Stored, and so no longer laid out by key: the steps below would otherwise take that layout
    # over and keep a hot key in one task.
    kept = cut_lineage(items.join(repeated, key, "left_semi").select(key, "ts", "id"))
    span = F.make_dt_interval(days=F.lit(days))
    wanted = kept if asked is None else asked.join(repeated, key, "left_semi")
    wanted = wanted.select(key, "ts", "id", (F.col("ts") - span).alias("at"))
    firsts = earliest_at_or_after(kept, wanted.select(key, "at"), [key])
    found = wanted.join(by_shuffle(firsts), [key, "at"])
    return found.filter(F.col("hit") < F.struct("ts", "id")).select(
        "id", F.col("hit.id").alias("original")
    )


def exact_originals(
    items: DataFrame, days: int = fixed.EXACT_LOOKBACK_DAYS, asked: DataFrame | None = None
) -> DataFrame:
    """(id, original): the earliest earlier item with the same text hash within ``days``.

    ``items`` needs id, ts and text_hash.  ``asked`` restricts the answer to some of the items.
    Items without an original are left out.
    """
    return _originals_by_key(items, "text_hash", days, asked)


def period_of(ts: Column, days: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(days * 86_400_000_000)).cast("bigint")


def _triple_keys(hashes: DataFrame, simhash: str) -> DataFrame:
    keys = F.transform(_mask_array(), lambda mask: F.col(simhash).bitwiseAND(mask))
    return hashes.select("*", F.posexplode(keys).alias("triple", "kept"))


def _two_flips(rows: DataFrame, simhash: str) -> DataFrame:
    """Each row 2,081 times, with ``centre``: all values at most two bits away from its hash."""
    first = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("_first"))
    # Two different bits, the second possibly none; or none at all, once.
    later = F.when(F.col("_first") == 64, F.array(F.lit(64))).otherwise(
        F.sequence(F.col("_first") + 1, F.lit(64))
    )
    centre = _flipped(_flipped(F.col(simhash), F.col("_first")), F.col("_second"))
    return first.select("*", F.explode(later).alias("_second")).select(*rows.columns, centre.alias("centre"))


def near_keys(items: DataFrame, days: int = fixed.NEAR_LOOKBACK_DAYS) -> DataFrame:
    """The near index of ``items`` (id, ts, simhash): (simhash, period, first, last, triple, kept).

    A span is all occurrences of a hash in one period of ``days``: the first of them and the time of
    the last.  It has a row for each of the twenty keys.  A table of them may be written once and read
    by later look-ups; parts of it may come from different batches.
    """
    spans = items.groupBy("simhash", period_of(F.col("ts"), days).alias("period")).agg(
        F.min(F.struct("ts", "id")).alias("first"), F.max("ts").alias("last")
    )
    return _triple_keys(spans, "simhash")


_KEY = ["triple", "kept", "period"]


def _near_in_keys(probes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, open, hit, at) from spans that share a key with a probe.

    A span that begins in the probe's window answers with its first occurrence: of those only the
    earliest is kept, one row per probe.  Of a span that begins before the window and ends in it the
    first occurrence inside is not known here: such a hash is ``open``, with a row of its own.
    """
    others = known.select(*_KEY, F.col("simhash").alias("neighbour"), "first", "last")
    near = F.bit_count(F.col("simhash").bitwiseXOR(F.col("neighbour"))).between(1, fixed.NEAR_DISTANCE)
    met = probes.join(by_shuffle(others), _KEY).filter(
        near & (F.col("last") >= F.col("at")) & (F.col("first") < F.struct("ts", "id"))
    )
    inside = F.col("first.ts") >= F.col("at")
    return met.groupBy("id", F.when(~inside, F.col("neighbour")).alias("open")).agg(
        F.min(F.when(inside, F.col("first"))).alias("hit"), F.max("at").alias("at")
    )


def _near_in_crowds(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """The same from crowded keys, without comparing the members of a key.

    Two hashes are at most three bits apart exactly if some value lies within one bit of the one and
    two bits of the other.  Spans list the 65 values around them, probes the 2,081 around them, and at
    each value a probe finds the first span that begins in its window by an ordered look-up, so the
    work is linear in the number of hashes however many are near each other.  Only spans of several
    occurrences that begin before a window are met one by one.
    """
    around = spans.withColumn("centre", _within_one("simhash"))
    asked = _two_flips(probes, "simhash")
    begins = around.select("centre", F.col("first.ts").alias("ts"), F.col("first.id").alias("id"))
    firsts = earliest_at_or_after(begins, asked.select("centre", "at"), ["centre"])
    found = (
        asked.join(by_shuffle(firsts), ["centre", "at"])
        .filter(F.col("hit") < F.struct("ts", "id"))
        .groupBy("id")
        .agg(F.min("hit").alias("hit"), F.max("at").alias("at"))
        .select("id", F.lit(None).cast("bigint").alias("open"), "hit", "at")
    )
    several = around.filter(F.col("last") > F.col("first.ts")).select(
        "centre", F.col("simhash").alias("neighbour"), "first", "last"
    )
    straddling = (
        asked.join(by_shuffle(several), "centre")
        .filter((F.col("first.ts") < F.col("at")) & (F.col("last") >= F.col("at")))
        .filter(F.col("simhash") != F.col("neighbour"))
        .groupBy("id", F.col("neighbour").alias("open"))
        .agg(F.max("at").alias("at"))
        .select("id", "open", F.lit(None).cast("struct<ts: timestamp, id: bigint>").alias("hit"), "at")
    )
    return found.unionByName(straddling)


def near_originals(
    items: DataFrame,
    days: int = fixed.NEAR_LOOKBACK_DAYS,
    asked: DataFrame | None = None,
    crowded: int = CROWDED_TRIPLE,
    index: DataFrame | None = None,
) -> DataFrame:
    """(id, original) of items with an earlier item at most three simhash bits away.

    ``items`` needs id, ts and simhash.  An item with the same simhash is preferred, else the
    earliest one within the distance: only items without the former are compared with other hashes,
    and of a hash only its first occurrence per ``days``.  One row per item is stored on the way, not
    one per near pair.  ``index`` is a stored table of ``near_keys`` of all items, if there is one;
    then only rows of it that share a key with what is asked are shuffled.
    """
    slim = items.select("id", "ts", "simhash")
    wanted = slim if asked is None else asked.select("id", "ts", "simhash")
    # Written once: they are small, and several branches below read them.
    same = cut_lineage(
        _originals_by_key(slim, "simhash", days, None if asked is None else wanted)
    )
    span = F.make_dt_interval(days=F.lit(days))
    this = period_of(F.col("ts"), days)
    # The look-back reaches into the item's own period and the one before it.
    probes = cut_lineage(
        wanted.join(by_shuffle(same), "id", "left_anti").select(
            "id", "ts", "simhash", (F.col("ts") - span).alias("at"),
            F.explode(F.array(this, this - 1)).alias("period"),
        )
    )
    keyed = _triple_keys(probes, "simhash")
    known = near_keys(slim, days) if index is None else index
    if asked is not None:
        known = cut_lineage(with_keys_of(known, keyed, _KEY))
    # Stored: whether there are any decides which plan is needed, and usually there are none.
    full = cut_lineage(
        known.groupBy(*_KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).select(*_KEY)
    )
    if full.isEmpty():
        found = _near_in_keys(keyed, known)
    else:
        few = _near_in_keys(keyed, known.join(full, _KEY, "left_anti"))
        in_crowd = keyed.join(full, _KEY, "left_semi").select("id", "ts", "simhash", "at").distinct()
        spans = known.join(full, _KEY, "left_semi").select("simhash", "period", "first", "last").distinct()
        found = few.unionByName(_near_in_crowds(cut_lineage(in_crowd), cut_lineage(spans)))
    found = cut_lineage(found)
    hits = found.filter("open IS NULL").select("id", "hit")
    questions = found.filter("open IS NOT NULL").select("id", F.col("open").alias("simhash"), "at").distinct()
    if not questions.isEmpty():
        occurrences = cut_lineage(with_keys_of(slim, questions, ["simhash"]))
        firsts = earliest_at_or_after(occurrences, questions.select("simhash", "at"), ["simhash"])
        hits = hits.unionByName(questions.join(by_shuffle(firsts), ["simhash", "at"]).select("id", "hit"))
    earliest = hits.groupBy("id").agg(F.min("hit").alias("hit"))
    return same.unionByName(earliest.select("id", F.col("hit.id").alias("original")))


def originals(
    items: DataFrame, asked: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """(id, duplicate_of) of all duplicates: same text first, near text second.

    ``items`` (id, ts, text_hash, simhash) is read by several branches; pass a stored table.
    ``index`` is as in ``near_originals``.
    """
    exact = exact_originals(items, asked=asked)
    near = near_originals(items, asked=asked, index=index)
    return (
        exact.withColumn("_rank", F.lit(0))
        .unionByName(near.withColumn("_rank", F.lit(1)))
        .groupBy("id")
        .agg(F.min_by("original", "_rank").alias("duplicate_of"))
    )


def mark_duplicates(items: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``duplicate_of``; a duplicate's reject_rule becomes 'duplicate' before all others."""
    marked = items.join(found.select("id", "duplicate_of"), "id", "left")
    if "reject_rule" not in items.columns:
        return marked
    return marked.withColumn(
        "reject_rule",
        F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("reject_rule")),
    )


def duplicate_counts(found: DataFrame, matches: DataFrame) -> DataFrame:
    """(match_id, raw_item_id, duplicate_count) of matches whose item has duplicates."""
    counts = found.groupBy("duplicate_of").agg(F.count("*").alias("duplicate_count"))
    return counts.join(matches, counts["duplicate_of"] == matches["raw_item_id"]).select(
        matches["id"].alias("match_id"), "raw_item_id", counts["duplicate_count"]
    )
