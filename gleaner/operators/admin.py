"""Change logs of the hand-edited tables, folded to current rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.operators.ordered import earliest_at_or_after, latest_rows
from gleaner.session import by_shuffle, cut_lineage, with_keys_of

DEFAULT_MUTE_HOURS = 24 * 365


def insert_if_absent(
    table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """``table`` plus those rows whose key it does not hold; of a new key the first in ``order``."""
    new = rows.join(table.select(*keys), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    firsts = new.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return table.unionByName(firsts.select(*keys, "_first.*"), allowMissingColumns=True)


def source_stubs(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows for sources that items name and the table lacks: category other, circuit main."""
    named = items.filter(F.length("source") > 0).select(F.col("source").alias("name")).distinct()
    known = sources.select(F.lower("name").alias("_known")).distinct()
    return named.join(known, F.lower("name") == F.col("_known"), "left_anti").select(
        "name",
        F.lit("other").alias("category"),
        F.lit("main").alias("circuit"),
        F.lit(True).alias("enabled"),
        F.lit(0).alias("priority"),
    )


def keyword_state(log: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Keyword rows after the commands (id, ts, action, dict_type, term, weight) of a log.

    ``add`` sets weight (default 1) and enables; ``del`` disables a known term and keeps its
    weight.  Commands with an unknown dictionary are refused.
    """
    known = log.filter(F.col("dict_type").isin(fixed.DICT_TYPES)).withColumn(
        "term", F.lower("term")
    )
    order = F.struct("ts", "id")
    adds = F.col("action") == "add"
    folded = known.groupBy("dict_type", "term").agg(
        F.max_by(F.coalesce("weight", F.lit(1)), F.when(adds, order)).alias("weight"),
        F.max(F.when(adds, order)).alias("_added"),
        F.max(order).alias("_last"),
    )
    state = folded.select(
        "dict_type",
        "term",
        "weight",
        F.col("_last").eqNullSafe(F.col("_added")).alias("enabled"),
        F.col("_added").isNotNull().alias("_inserted"),
    )
    if table is None:
        return state.filter("_inserted").drop("_inserted").withColumn(
            "maps_to", F.lit(None).cast("string")
        )
    old = table.select(
        "dict_type",
        "term",
        F.col("weight").alias("_weight"),
        "maps_to",
        F.col("enabled").alias("_enabled"),
        F.lit(True).alias("_old"),
    )
    # A disable of a term neither in the table nor ever added leaves no row.
    return (
        state.join(old, ["dict_type", "term"], "full")
        .filter(F.coalesce("_inserted", F.lit(False)) | F.coalesce("_old", F.lit(False)))
        .select(
            "dict_type",
            "term",
            F.coalesce("weight", "_weight").alias("weight"),
            F.coalesce("enabled", "_enabled").alias("enabled"),
            "maps_to",
        )
    )


def weight_state(log: DataFrame) -> DataFrame:
    """Current rule weights from a log of (id, ts, key, weight); a threshold is one of them."""
    return latest_rows(log.select("id", "ts", "key", "weight"), ["key"], ["ts", "id"]).select(
        "key", "weight"
    )


def weights_listing(weights: DataFrame) -> DataFrame:
    return weights.select("key", "weight").orderBy("key")


def source_state(sources: DataFrame, log: DataFrame) -> DataFrame:
    """Sources after mute, unmute and category commands (id, ts, action, name, hours, category).

    Commands for unknown sources change nothing; unknown categories are refused.
    """
    order = F.struct("ts", "id")
    mutes = F.col("action").isin("mute", "unmute")
    files = (F.col("action") == "category") & F.col("category").isin(fixed.CATEGORIES)
    hours = F.coalesce("hours", F.lit(DEFAULT_MUTE_HOURS))
    until = F.when(
        F.col("action") == "mute", F.col("ts") + F.make_dt_interval(hours=hours)
    )
    # Structs, because an unmute sets null and must still win over an older mute.
    folded = log.groupBy("name").agg(
        F.max_by(F.struct(until.alias("until")), F.when(mutes, order)).alias("_mute"),
        F.max_by("category", F.when(files, order)).alias("_category"),
    )
    return sources.join(folded, "name", "left").select(
        *[
            F.coalesce("_category", "category").alias("category")
            if c == "category"
            else F.when(F.col("_mute").isNotNull(), F.col("_mute.until"))
            .otherwise(F.col("muted_until"))
            .alias("muted_until")
            if c == "muted_until"
            else F.col(c)
            for c in sources.columns
        ]
    )


def feedback_events(clicks: DataFrame) -> DataFrame:
    """Feedback rows of favourite and not-this clicks (id, ts, match_id, action, reason)."""
    good = F.col("action") == "favorite"
    bad = (F.col("action") == "not_this") & F.col("reason").isin(fixed.FEEDBACK_REASONS)
    return clicks.filter(good | bad).select(
        "id",
        "match_id",
        F.when(good, "good").otherwise("bad").alias("verdict"),
        F.when(~good, F.col("reason")).alias("reason"),
        F.col("ts").alias("created_at"),
    )


def favorite_matches(clicks: DataFrame) -> DataFrame:
    return clicks.filter(F.col("action") == "favorite").select("match_id").distinct()


def match_status(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches with the status of their last event (id, ts, match_id, status).

    ``notified_at`` is the time of the last delivery.
    """
    order = F.struct("ts", "id")
    last = events.groupBy(F.col("match_id").alias("_match")).agg(
        F.max_by("status", order).alias("_status"),
        F.max(F.when(F.col("status") == "notified", F.col("ts"))).alias("_sent"),
    )
    return matches.join(last, matches["id"] == last["_match"], "left").select(
        *[matches[c] for c in matches.columns if c not in ("status", "notified_at")],
        F.coalesce("_status", matches["status"]).alias("status"),
        F.coalesce("_sent", matches["notified_at"]).alias("notified_at"),
    )


def first_seen(
    items: DataFrame,
    key: str = "item_id",
    days: int = fixed.ITEM_ID_LOOKBACK_DAYS,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Add ``is_first``: the key is not registered when the item comes.

    The first item of a key registers it for ``days``, both ends included; items within that time
    do not renew it, and the first item after it registers the key again.  A key whose items all lie
    within ``days`` of the first is settled by one aggregate.  Of the others every item gets a
    pointer to the one that would follow it as a registration.  The registrations of a key are one
    path of pointers from its first item, so doubled pointers reach all of them in as many rounds as
    their number has binary digits, each of them once.
    """
    span = F.make_dt_interval(days=F.lit(days), secs=F.lit(0.000001))
    slim = cut_lineage(items.select(key, "ts", "id"))
    starts = cut_lineage(
        slim.groupBy(key).agg(F.min(F.struct("ts", "id")).alias("hit"), F.max("ts").alias("last"))
    )
    reached = [starts.select(F.col("hit.id").alias("here"))]
    long = cut_lineage(starts.filter(F.col("last") >= F.col("hit.ts") + span).select(key))
    if not long.isEmpty():
        slim = cut_lineage(with_keys_of(slim, long, [key]))
        probes = slim.select(key, "id", (F.col("ts") + span).alias("at"))
        after = earliest_at_or_after(slim, probes, [key], chunk_seconds).filter("hit IS NOT NULL")
        jumps = cut_lineage(
            probes.join(by_shuffle(after), [key, "at"]).select(F.col("id").alias("here"), F.col("hit.id").alias("to"))
        )
        while True:
            all_reached = functools.reduce(DataFrame.unionAll, reached)
            new = cut_lineage(all_reached.join(jumps, "here").select(F.col("to").alias("here")))
            if new.isEmpty():
                break
            reached.append(new)
            further = jumps.select(F.col("here").alias("to"), F.col("to").alias("beyond"))
            jumps = cut_lineage(jumps.join(further, "to").select("here", F.col("beyond").alias("to")))
    firsts = functools.reduce(DataFrame.unionAll, reached).select(
        F.col("here").alias("id"), F.lit(True).alias("_first")
    )
    return items.join(by_shuffle(firsts), "id", "left").select(
        *[F.col(c) for c in items.columns], F.coalesce("_first", F.lit(False)).alias("is_first")
    )
