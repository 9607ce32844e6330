"""Hard rejection rules.  Each is a Column that holds the rule's name, or null if it passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions.scoring import has_any, is_hiring_tag, is_offer_tag
from gleaner.functions.text import java_pattern, match_positions, near, starts_within
from gleaner.rules import RuleSet


def length_gate(text_norm: Column) -> Column:
    size = F.length(text_norm)
    return F.when(
        (size < fixed.MIN_LENGTH) | (size > fixed.MAX_LENGTH), F.lit("HF-1_length")
    )


def signal_gate(terms: Column, tag: Column, helped: Column, skip: Column) -> Column:
    found = has_any(terms["hiring"]) | has_any(terms["pain"]) | helped | is_hiring_tag(tag)
    return F.when(~skip & ~found, F.lit("HF-2_no_signal"))


def closed_gate(text_norm: Column, hiring: Column, rules: RuleSet) -> Column:
    """A closing phrase near the start, or within a few tokens of the first hiring phrase.

    Positions are only worked out for texts with both kinds of phrase; texts longer than the
    length gate allows are never asked, so the work per text is bounded.
    """
    closed, wanted = rules.patterns["closed"], rules.patterns["hiring"]
    if closed is None:
        return F.lit(None).cast("string")
    hit = starts_within(text_norm, closed, fixed.CLOSED_HEAD_CHARS)
    if wanted is not None:
        first = F.length(F.element_at(F.split(text_norm, java_pattern(wanted), 2), 1))
        beside = F.exists(
            match_positions(text_norm, closed),
            lambda at: near(text_norm, at, first, fixed.CLOSED_NEAR_TOKENS),
        )
        both = has_any(hiring) & text_norm.rlike(java_pattern(closed))
        hit = F.when(hit, True).when(both, beside).otherwise(False)
    return F.when(hit, F.lit("HF-3_closed"))


def low_info_gate(
    text_norm: Column, terms: Column, helped: Column, skip: Column
) -> Column:
    found = has_any(terms["hiring"]) | has_any(terms["pain"]) | helped
    short = F.length(text_norm) < fixed.LOW_INFO_LENGTH
    return F.when(~skip & short & ~found, F.lit("HF-4_low_info"))


def offer_gate(text_norm: Column, tag: Column, rules: RuleSet) -> Column:
    offered = starts_within(text_norm, rules.patterns["anti"], fixed.OFFER_HEAD_CHARS)
    return F.when(is_offer_tag(tag) | offered, F.lit("HF-5_service_offer"))


def body_gate(has_body: Column, hiring: Column, tag: Column) -> Column:
    return F.when(
        ~has_body & ~has_any(hiring) & ~is_hiring_tag(tag), F.lit("HF-6_no_body")
    )


def reject_rule(
    *,
    text_norm: Column,
    terms: Column,
    tag: Column,
    has_body: Column,
    helped: Column,
    skip_soft: Column,
    rules: RuleSet,
) -> Column:
    """The first rule that fires, in order; later rules are not evaluated for that row."""
    return F.coalesce(
        length_gate(text_norm),
        signal_gate(terms, tag, helped, skip_soft),
        closed_gate(text_norm, terms["hiring"], rules),
        low_info_gate(text_norm, terms, helped, skip_soft),
        offer_gate(text_norm, tag, rules),
        body_gate(has_body, terms["hiring"], tag),
    )
