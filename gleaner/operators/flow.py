"""The whole way of an item, from the feed to its route; batch and stream share it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import text
from gleaner.operators import dedup, items as item_ops, verdicts
from gleaner.rules import RuleSet
from gleaner.session import broadcast_if_small, cut_lineage


@dataclass(frozen=True)
class FlowResult:
    raw_items: DataFrame
    matches: DataFrame
    work: DataFrame
    duplicates: DataFrame


def analyse(
    feed: DataFrame,
    sources: DataFrame,
    rules: RuleSet,
    now: Column,
    token_hash: str = "blake2b",
    score_rejected: bool = True,
) -> DataFrame:
    """Everything that needs an item's text, in one pass without a shuffle.

    Gate, normalise, hash, match, reject and score: later steps read only the results.  Rejected
    items give no match, so those who do not store their scores need not have them worked out.
    """
    placed = item_ops.source_gate(feed, sources, now)
    matched = item_ops.match_items(item_ops.normalize_items(placed, rules), rules)
    rejected = item_ops.reject_items(item_ops.hash_items(matched, token_hash), rules)
    unscored = rejected.withColumn("author_bonus", F.lit(0))
    passed = None if score_rejected else F.col("reject_rule").isNull()
    return item_ops.score_items(unscored, rules, passed)


def process(
    feed: DataFrame,
    sources: DataFrame,
    authors: DataFrame,
    rules: RuleSet,
    now: Column,
    index: DataFrame | None = None,
    classifier_on: bool = True,
    zone: str = "UTC",
    token_hash: str = "blake2b",
) -> FlowResult:
    """Process items (id, ts and the feed columns) against earlier ones."""
    facts = cut_lineage(analyse(feed, sources, rules, now, token_hash, score_rejected=False))
    return resolve(facts, authors, rules, index, classifier_on, zone, now)


def resolve(
    facts: DataFrame,
    authors: DataFrame,
    rules: RuleSet,
    index: DataFrame | None = None,
    classifier_on: bool = True,
    zone: str = "UTC",
    now: Column | None = None,
    near_index: DataFrame | None = None,
) -> FlowResult:
    """Duplicates, matches and work of analysed items; ``facts`` is a stored table.

    ``now`` is the moment of the decision, which quiet hours go by; without it an item counts as
    decided at its own time.

    ``index`` has id, ts, text_hash and simhash of the items before.  Duplicates are looked up
    over both; every item is a possible original, rejected or not.  ``near_index`` has the
    ``dedup.near_keys`` of both.
    """
    keys = facts.select("id", "ts", "text_hash", "simhash")
    if index is None:
        found = dedup.originals(keys)
    else:
        found = dedup.originals(
            index.select("id", "ts", "text_hash", "simhash").unionByName(keys),
            asked=keys,
            index=near_index,
        )
    found = broadcast_if_small(found)
    # The rule is part of the stored facts, so it is applied in the scan, before any join.  Texts
    # stay out of all joins but the one that hands them to the classifier.
    slim = facts.filter("reject_rule IS NULL").select(
        "id",
        "ts",
        "circuit",
        "source",
        "author_handle",
        "score",
        "signals",
        F.col("terms.stack").alias("stack_matched"),
        "intent_tag",
        "compensation",
        "contact",
        text.headline(F.col("title")).alias("headline"),
    )
    scored = add_author_points(slim.join(found, "id", "left_anti"), authors, rules)
    decided = item_ops.decide_items(scored, rules, classifier_on).select(
        "id",
        F.col("id").alias("raw_item_id"),
        "ts",
        "circuit",
        "source",
        "score",
        "signals",
        "stack_matched",
        "intent_tag",
        "compensation",
        "contact",
        "headline",
        F.lit(rules.version).alias("rules_version"),
        "mode",
        "rule_hint",
        "rules_notify",
    )
    waiting = F.col("mode").isNotNull()
    routed = verdicts.route_items(
        decided.withColumns(
            {
                "decided_by": F.lit("rules"),
                "llm_status": F.when(waiting, "pending").otherwise("not_needed"),
                "will_notify": F.col("rules_notify"),
            }
        ),
        zone=zone,
        at="ts" if now is None else now,
    )
    raw = dedup.mark_duplicates(facts, found).select(
        "id",
        "source",
        "circuit",
        "item_id",
        "author_handle",
        "permalink",
        "tag",
        "title",
        "posted_at",
        "text",
        "text_norm",
        "text_hash",
        "simhash",
        "has_body",
        "struct_features",
        "reject_rule",
        F.col("ts").alias("created_at"),
        "duplicate_of",
    )
    return FlowResult(
        raw_items=raw,
        matches=stored_matches(routed),
        work=verdicts.work_list(with_texts(decided.filter("mode IS NOT NULL"), facts)),
        duplicates=found,
    )


def with_texts(decided: DataFrame, facts: DataFrame) -> DataFrame:
    """Decided items with title and text; only the texts that are asked for move."""
    asked = broadcast_if_small(decided.select("id", "mode", "rule_hint"))
    return facts.select("id", "source", "circuit", "title", "text").join(asked, "id")


def stored_matches(routed: DataFrame) -> DataFrame:
    """Routed items with the columns of ``schemas.MATCHES``, plus ``mode``, ``queue`` and ``ts``.

    What only later steps know (verdicts, deliveries, duplicate counts, favourites) is empty.
    """
    later = {
        "llm_verdict": F.lit(None).cast(schemas.VERDICT),
        "llm_summary_ru": F.lit(None).cast("string"),
        "llm_prob": F.lit(None).cast("double"),
        "model_version": F.lit(None).cast("string"),
        "duplicate_count": F.lit(0),
        "duplicate_of": F.lit(None).cast("bigint"),
        "notified_at": F.lit(None).cast("timestamp"),
        "notification_msg_id": F.lit(None).cast("bigint"),
        "is_favorite": F.lit(False),
    }
    return routed.drop("source", "rule_hint").withColumns(
        later | {"created_at": F.col("ts")}
    )


def add_author_points(scored: DataFrame, authors: DataFrame, rules: RuleSet) -> DataFrame:
    """Add the author bonus to score and signals of scored items."""
    bonus = item_ops.with_author_bonus(scored.drop("author_bonus"), authors, rules)
    return bonus.withColumns(
        {
            "score": F.col("score") + F.col("author_bonus"),
            "signals": F.when(
                F.col("author_bonus") != 0,
                F.map_concat(
                    "signals", F.create_map(F.lit("author_reputation"), F.col("author_bonus"))
                ),
            ).otherwise(F.col("signals")),
        }
    )
