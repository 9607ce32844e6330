"""Item jobs: gate by source, normalise, match terms, reject, score, decide, dry run.

A filter on a computed column moves below the projection that computes it and repeats its work
there.  So the jobs count with conditions, and results that are to be filtered are stored first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions import decisions, gates, scoring, text
from gleaner.functions.hashing import simhash64, text_hash
from gleaner.rules import RuleSet
from gleaner.session import bound_arrow_batches, broadcast_if_small

TERM_KINDS = ("stack", "hiring", "pain", "money", "noise")


def source_gate(
    items: DataFrame, sources: DataFrame, now: Column, drop_blocked: bool = True
) -> DataFrame:
    """Attach category, circuit and priority; drop items of disabled or muted sources.

    Names compare without case.  An unknown source counts as category other, circuit main,
    priority 0.  ``drop_blocked=False`` keeps everything, as a dry run does.
    """
    # max_by over the whole row: names that differ in case only give one row per item.
    known = (
        sources.groupBy(F.lower("name").alias("_source_key"))
        .agg(
            F.max_by(
                F.struct("name", "category", "circuit", "enabled", "muted_until", "priority"),
                F.col("name"),
            ).alias("_source")
        )
    )
    known = broadcast_if_small(known)
    joined = items.join(known, F.lower(items["source"]) == known["_source_key"], "left")
    if drop_blocked:
        muted = F.coalesce(F.col("_source.muted_until") > now, F.lit(False))
        joined = joined.filter(F.coalesce(F.col("_source.enabled"), F.lit(True)) & ~muted)
    return joined.select(
        *[items[c] for c in items.columns if c not in ("source", "circuit")],
        F.coalesce("_source.name", items["source"]).alias("source"),
        F.coalesce("_source.circuit", F.lit("main")).alias("circuit"),
        F.coalesce("_source.category", F.lit("other")).alias("category"),
        F.coalesce("_source.priority", F.lit(0)).alias("priority"),
    )


def drop_stale(
    items: DataFrame, now: Column, minutes: int = fixed.MAX_ITEM_AGE_MINUTES
) -> DataFrame:
    """Drop items posted before ``now - minutes``; an unknown or unreadable time is kept."""
    return items.filter(~is_stale(items["posted_at"], now, minutes))


def is_stale(posted_at: Column, now: Column, minutes: int = fixed.MAX_ITEM_AGE_MINUTES) -> Column:
    limit = now - F.make_dt_interval(mins=F.lit(minutes))
    return F.coalesce(F.try_to_timestamp(posted_at.cast("string")) < limit, F.lit(False))


def normalize_items(items: DataFrame, rules: RuleSet) -> DataFrame:
    """Add text, text_norm and struct_features.

    Stored items have no title and body of their own any more, but the text made of them.
    """
    whole = text.raw_text(F.col("title"), F.col("body")) if "body" in items.columns else F.col("text")
    # One column per step: an expression that is used several times below would otherwise be
    # computed for each use.
    return (
        items.withColumn("text", whole)
        .withColumn("_plain", text.normalize_text(F.col("text")))
        .withColumns(
            {
                "text_norm": text.apply_aliases(F.col("_plain"), rules.aliases),
                "struct_features": text.struct_features(F.col("text"), F.col("has_body")),
            }
        )
        .drop("_plain")
    )


def match_items(items: DataFrame, rules: RuleSet, soft_help: bool = True) -> DataFrame:
    """Add the struct ``terms`` of matched terms and the flag ``help_request``.

    Gates and scores both read these columns, so each dictionary scans a text once.
    """
    found = items.withColumn(
        "terms",
        F.struct(
            *[
                text.matched_terms(F.col("text_norm"), rules.patterns[kind]).alias(kind)
                for kind in TERM_KINDS
            ]
        ),
    )
    helped = (
        scoring.help_request(
            F.col("text_norm"),
            F.col("struct_features.title_is_question"),
            F.col("terms.stack"),
            F.col("terms.noise"),
            rules,
        )
        if soft_help
        else F.lit(False)
    )
    return found.withColumn("help_request", helped)


def reject_items(items: DataFrame, rules: RuleSet, soft_gates_for_browse: bool = False) -> DataFrame:
    """Add ``reject_rule``.  Items outside the main circuit skip the two soft gates."""
    skip = F.lit(False) if soft_gates_for_browse else F.col("circuit") != "main"
    return items.withColumn(
        "reject_rule",
        gates.reject_rule(
            text_norm=F.col("text_norm"),
            terms=F.col("terms"),
            tag=F.col("tag"),
            has_body=F.col("has_body"),
            helped=F.col("help_request"),
            skip_soft=skip,
            rules=rules,
        ),
    )


def score_items(items: DataFrame, rules: RuleSet, passed: Column | None = None) -> DataFrame:
    """Add contact, compensation, signals, score and intent_tag.

    Needs category, priority and author_bonus next to the columns of ``match_items``.  With
    ``passed``, only the items it holds for are searched and scored; of the others contact,
    compensation, signals and score are null.
    """

    def asked(value: Column) -> Column:
        return value if passed is None else F.when(passed, value)

    with_finds = items.withColumns(
        {
            "contact": asked(scoring.contact(F.col("text_norm"))),
            "compensation": asked(scoring.compensation(F.col("text_norm"))),
        }
    )
    fired = scoring.fired_rules(
        text_norm=F.col("text_norm"),
        features=F.col("struct_features"),
        terms=F.col("terms"),
        tag=F.col("tag"),
        category=F.col("category"),
        priority=F.col("priority"),
        bonus=F.col("author_bonus"),
        contact_found=F.col("contact"),
        money_found=F.col("compensation"),
        helped=F.col("help_request"),
        rules=rules,
    )
    return with_finds.withColumn("_fired", asked(fired)).withColumns(
        {
            "score": scoring.score_of(F.col("_fired")),
            "signals": scoring.signals_of(F.col("_fired")),
            "intent_tag": scoring.intent_tag(
                F.col("terms.hiring"), F.col("terms.pain"), F.col("tag"), F.col("help_request")
            ),
        }
    ).drop("_fired")


def with_author_bonus(items: DataFrame, authors: DataFrame, rules: RuleSet) -> DataFrame:
    """Left join of the author counters; unknown or missing authors get 0."""
    counters = broadcast_if_small(
        authors.select(F.col("handle").alias("author_handle"), "good_count", "bad_count")
    )
    bonus = scoring.author_bonus(
        F.coalesce("good_count", F.lit(0)), F.coalesce("bad_count", F.lit(0)), rules
    )
    return (
        items.join(counters, "author_handle", "left")
        .withColumn("author_bonus", bonus)
        .drop("good_count", "bad_count")
    )


def hash_items(items: DataFrame, token_hash: str = "blake2b") -> DataFrame:
    """Add text_hash and simhash of the normalised text."""
    bound_arrow_batches(items.sparkSession)
    return items.withColumns(
        {
            "text_hash": text_hash(F.col("text_norm")),
            "simhash": simhash64(F.col("text_norm"), token_hash),
        }
    )


def decide_items(items: DataFrame, rules: RuleSet, classifier_on: bool = True) -> DataFrame:
    """Add mode, rule_hint and rules_notify to scored items."""
    score, intent, circuit = F.col("score"), F.col("intent_tag"), F.col("circuit")
    return items.withColumns(
        {
            "mode": decisions.decision_mode(score, intent, circuit, rules, classifier_on),
            "rule_hint": decisions.decision_hint(score, intent, circuit, rules),
            "rules_notify": score >= rules.notify_threshold,
        }
    )


def dry_run(items: DataFrame, sources: DataFrame, rules: RuleSet, soft_help: bool = True) -> DataFrame:
    """Replay items through the current rules without de-duplication and author bonus.

    All gates apply to both circuits here.  One row per item; nothing is shuffled unless the
    source table is too large to broadcast.
    """
    placed = source_gate(items, sources, F.current_timestamp(), drop_blocked=False)
    matched = match_items(normalize_items(placed, rules), rules, soft_help)
    rejected = reject_items(matched, rules, soft_gates_for_browse=True)
    return score_items(rejected.withColumn("author_bonus", F.lit(0)), rules)


def dry_run_flags(replayed: DataFrame, rules: RuleSet) -> DataFrame:
    """Add passed, would_notify, would_classify and would_translate."""
    passed = F.col("reject_rule").isNull()
    notify = passed & (F.col("score") >= rules.notify_threshold)
    classify = passed & decisions.needs_classifier(F.col("score"), F.col("intent_tag"), rules)
    return replayed.withColumns(
        {
            "passed": passed,
            "would_notify": notify,
            "would_classify": classify,
            "would_translate": notify & ~classify,
        }
    )


def last_items(items: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` stored items, at most 500."""
    return items.orderBy(F.desc("created_at"), F.desc("id")).limit(
        min(n, fixed.DRY_RUN_MAX_ITEMS)
    )


def reject_counts(replayed: DataFrame) -> DataFrame:
    """Items per reject rule, most frequent first."""
    return (
        replayed.groupBy("reject_rule")
        .agg(F.count_if(F.col("reject_rule").isNotNull()).alias("items"))
        .filter("items > 0")
        .orderBy(F.desc("items"), "reject_rule")
    )


def passed_by_intent(replayed: DataFrame) -> DataFrame:
    return (
        replayed.groupBy("intent_tag")
        .agg(F.count_if(F.col("reject_rule").isNull()).alias("items"))
        .filter("items > 0")
        .orderBy("intent_tag")
    )


def dry_run_summary(replayed: DataFrame, rules: RuleSet) -> DataFrame:
    """One row: items, passed, would_notify, would_classify, would_translate, calls."""
    flags = dry_run_flags(replayed, rules)
    return flags.agg(
        F.count("*").alias("items"),
        F.count_if("passed").alias("passed"),
        F.count_if("would_notify").alias("would_notify"),
        F.count_if("would_classify").alias("would_classify"),
        F.count_if("would_translate").alias("would_translate"),
        F.count_if(F.col("would_classify") | F.col("would_translate")).alias("calls"),
    )


def translate_only(replayed: DataFrame, rules: RuleSet) -> DataFrame:
    """Items to notify minus items to classify.

    Both sets come from the same rows, so the difference is a filter and needs no join.
    """
    return dry_run_flags(replayed, rules).filter("would_translate")


def top_candidates(replayed: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` passed items with the highest score."""
    passed = F.col("reject_rule").isNull()
    return (
        replayed.select(
            "id",
            "score",
            "intent_tag",
            "source",
            F.left("title", F.lit(100)).alias("title"),
            "signals",
            passed.alias("_passed"),
        )
        .orderBy(F.desc("_passed"), F.desc("score"), "id")
        .limit(n)
        .filter("_passed")
        .drop("_passed")
    )
