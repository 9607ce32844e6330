"""Score layers, signals, help request and intent as Column expressions over matched terms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions.text import java_pattern, literal_map
from gleaner.rules import RuleSet


def has_any(terms: Column) -> Column:
    return F.size(terms) > 0


def weight_sum(terms: Column, weights: Mapping[str, int], default: int = 0) -> Column:
    """Sum of the weights of the matched terms."""
    if not weights:
        return F.size(terms) * F.lit(default)
    table = literal_map(weights, "int")
    return F.aggregate(
        terms,
        F.lit(0),
        lambda total, term: total + F.coalesce(F.try_element_at(table, term), F.lit(default)),
    )


def is_hiring_tag(tag: Column) -> Column:
    return F.coalesce(tag.isin(fixed.TAGS_HIRING), F.lit(False))


def is_offer_tag(tag: Column) -> Column:
    return F.coalesce(tag.isin(fixed.TAGS_SERVICE_OFFER), F.lit(False))


def help_request(
    text_norm: Column, title_is_question: Column, stack: Column, noise: Column, rules: RuleSet
) -> Column:
    """A request for help on our subject: a core term, no noise, and one sign of asking."""
    core = [t for t, weight in rules.stack.items() if weight >= fixed.CORE_MIN_WEIGHT]
    if not core:
        return F.lit(False)
    core_hits = F.size(F.array_intersect(stack, F.array(*map(F.lit, core))))
    # Ordered so that the long phrase pattern runs last, and only on texts with a core term.
    return (
        F.when(~has_any(stack) | has_any(noise), False)
        .when(core_hits == 0, False)
        .when(title_is_question | (core_hits >= fixed.CORE_HITS_FOR_HELP), True)
        .otherwise(text_norm.rlike(java_pattern(rules.help_pattern)))
    )


def has_sections(text_norm: Column) -> Column:
    return F.contains(text_norm, F.lit(":")) & text_norm.rlike(java_pattern(fixed.SECTION_PATTERN))


def contact(text_norm: Column) -> Column:
    """First way of contact in the text, else null."""
    # Plain substring tests first: the mailbox part of the pattern is costly on other texts.
    possible = reduce(or_, [F.contains(text_norm, F.lit(x)) for x in fixed.CONTACT_LITERALS])
    first = F.regexp_extract(text_norm, java_pattern(fixed.CONTACT_PATTERN), 0)
    return F.when(possible, F.nullif(first, F.lit("")))


def compensation(text_norm: Column) -> Column:
    """First amount of money in the text, else null."""
    # Every amount holds a digit or the word budget; one cheap scan rules out most texts.
    possible = text_norm.rlike(java_pattern(r"\d|budget", "i"))
    first = F.regexp_extract(text_norm, java_pattern(fixed.MONEY_AMOUNT_PATTERN, "i"), 0)
    return F.when(possible, F.nullif(first, F.lit("")))


def intent_tag(hiring: Column, pain: Column, tag: Column, helped: Column) -> Column:
    hires = has_any(hiring) | is_hiring_tag(tag)
    return (
        F.when(hires & has_any(pain), "both")
        .when(hires, "hiring_intent")
        .when(has_any(pain), "pain_point")
        .when(helped, "help_request")
        .otherwise("unknown")
    )


def author_bonus(good: Column, bad: Column, rules: RuleSet) -> Column:
    return (
        F.when(good >= fixed.AUTHOR_GOOD_MIN, rules.weight("author_reputation_bonus"))
        .when((bad >= fixed.AUTHOR_BAD_MIN) & (good == 0), fixed.AUTHOR_PENALTY)
        .otherwise(0)
    )


def stack_points(stack: Column, rules: RuleSet) -> Column:
    return F.least(weight_sum(stack, rules.stack), F.lit(rules.stack_cap))


def intent_points(hiring: Column, pain: Column, money: Column, rules: RuleSet) -> Column:
    total = (
        weight_sum(hiring, rules.hiring)
        + weight_sum(pain, rules.pain)
        + weight_sum(money, rules.money)
    )
    return F.least(total, F.lit(rules.intent_cap))


def noise_points(noise: Column, rules: RuleSet) -> Column:
    return F.greatest(
        weight_sum(noise, rules.noise, fixed.NOISE_WEIGHT), F.lit(rules.noise_cap)
    )


def fired_rules(
    *,
    text_norm: Column,
    features: Column,
    terms: Column,
    tag: Column,
    category: Column,
    priority: Column,
    bonus: Column,
    contact_found: Column,
    money_found: Column,
    helped: Column,
    rules: RuleSet,
) -> Column:
    """All rules that fired, as ``array<struct<rule, points>>``; their points add up to the score.

    ``terms`` is the struct of matched terms (stack, hiring, pain, money, noise).
    """

    def entry(rule: str, points: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), points.cast("int").alias("points"))

    def nonzero(rule: str, points: Column) -> Column:
        return F.when(points != 0, entry(rule, points))

    def fixed_weight(rule: str, condition: Column) -> Column:
        return F.when(condition, entry(rule, F.lit(rules.weight(rule))))

    length = features["length"]
    return F.array_compact(
        F.array(
            nonzero("stack", stack_points(terms["stack"], rules)),
            nonzero(
                "intent", intent_points(terms["hiring"], terms["pain"], terms["money"], rules)
            ),
            fixed_weight("has_sections", has_sections(text_norm)),
            fixed_weight("has_contact", contact_found.isNotNull()),
            fixed_weight("has_money_pattern", money_found.isNotNull()),
            fixed_weight("has_bullets", features["bullet_line_count"] >= fixed.MIN_BULLETS),
            fixed_weight("long_len", length > fixed.LONG_TEXT),
            fixed_weight("short_len", length < fixed.SHORT_TEXT),
            fixed_weight("no_body", ~F.coalesce(features["has_body"], F.lit(False))),
            fixed_weight("no_stack", ~has_any(terms["stack"])),
            fixed_weight("help_question", helped),
            fixed_weight("tag_task", F.coalesce(tag == "task", F.lit(False))),
            fixed_weight(
                "tag_hiring", is_hiring_tag(tag) & F.coalesce(tag != "task", F.lit(False))
            ),
            fixed_weight("category_job_board", category == "job_board"),
            fixed_weight("category_ai_automation", category == "ai_automation"),
            fixed_weight("category_business_ops", category == "business_ops"),
            nonzero("source_priority", priority),
            nonzero("author_reputation", bonus),
            nonzero("noise", noise_points(terms["noise"], rules)),
        )
    )


def score_of(fired: Column) -> Column:
    return F.aggregate(fired, F.lit(0), lambda total, entry: total + entry["points"])


def signals_of(fired: Column) -> Column:
    """The fired rules as ``map<rule, points>``."""
    return F.map_from_entries(fired)
