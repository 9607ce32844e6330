"""What happens to a scored item: classifier call, verdict, quiet hours, route, card texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner import schemas
from gleaner.functions.text import strip
from gleaner.rules import RuleSet

CLASSIFY = "classify_and_translate"
TRANSLATE = "translate"


def needs_classifier(score: Column, intent: Column, rules: RuleSet) -> Column:
    return (
        F.when(intent == "unknown", False)
        .when(intent == "help_request", score >= rules.help_min_score)
        .otherwise(True)
    )


def decision_mode(
    score: Column, intent: Column, circuit: Column, rules: RuleSet, classifier_on: bool = True
) -> Column:
    """classify_and_translate, translate, or null when the rules decide alone."""
    if not classifier_on:
        return F.lit(None).cast("string")
    return (
        F.when((circuit != "main") | needs_classifier(score, intent, rules), CLASSIFY)
        .when(score >= rules.notify_threshold, TRANSLATE)
    )


def decision_hint(score: Column, intent: Column, circuit: Column, rules: RuleSet) -> Column:
    """The hint that goes to the classifier; empty unless the item is to be classified."""
    browse_before, browse_after = fixed.HINT_BROWSE.split("{circuit}")
    score_before, rest = fixed.HINT_SCORE.split("{score}")
    between, _ = rest.split("{threshold}")
    main = F.concat_ws(
        "; ",
        F.concat(
            F.lit(score_before),
            score.cast("string"),
            F.lit(between + str(rules.notify_threshold)),
        ),
        F.when(intent == "pain_point", fixed.HINT_PAIN).when(
            intent == "help_request", fixed.HINT_HELP
        ),
    )
    return (
        F.when(
            circuit != "main", F.concat(F.lit(browse_before), circuit, F.lit(browse_after))
        )
        .when(needs_classifier(score, intent, rules), main)
        .otherwise("")
    )


def classifier_text(source: Column, title: Column, text: Column) -> Column:
    """The item as the classifier reads it; its input limit is part of the interface."""
    parts = fixed.CLASSIFIER_ITEM_FORMAT
    head, rest = parts.split("{source}")
    middle, rest = rest.split("{title}")
    tail, _ = rest.split("{body}")
    whole = F.concat(F.lit(head), source, F.lit(middle), title, F.lit(tail), text)
    return F.left(whole, F.lit(fixed.CLASSIFIER_INPUT_CHARS))


def prompt_variant(circuit: Column) -> Column:
    return F.when(circuit == "main", "strict").otherwise("browse")


def parse_verdict(response: Column) -> Column:
    """Verdict struct of a raw classifier response; null if it is not a JSON object."""
    text = strip(response)
    bare = F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "(?i)^json", "")
    text = F.when(F.startswith(text, F.lit("```")), bare).otherwise(text)
    # variant keeps "not JSON" (null) apart from an object with missing keys
    value = F.try_parse_json(text)
    typed = F.from_json(text, schemas.VERDICT)
    loose = typed.withField("is_lead", _truth(value, "$.is_lead")).withField(
        "confidence", _number(value, "$.confidence")
    )
    return F.when(value.isNotNull() & text.rlike(r"^\s*\{"), loose)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _truth(value: Column, path: str) -> Column:
    """A JSON value as a condition: null if missing; false, 0 and empty values are false."""
    kind, word = _kind(value, path), F.try_variant_get(value, path, "string")
    return (
        F.when(kind.isNull() | (kind == "VOID"), None)
        .when(kind == "BOOLEAN", word == "true")
        .when(kind == "STRING", word != "")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~word.isin("[]", "{}"))
        .otherwise(F.coalesce(word.try_cast("double") != 0, F.lit(True)))
    )


def _number(value: Column, path: str) -> Column:
    """A JSON number, also one in quotes; null for anything else."""
    return F.trim(F.try_variant_get(value, path, "string")).try_cast("double")


def verdict_notifies(mode: Column, verdict: Column) -> Column:
    confident = F.coalesce(verdict["confidence"], F.lit(0.0)) >= fixed.VERDICT_CONFIDENCE
    return (mode == TRANSLATE) | (F.coalesce(verdict["is_lead"], F.lit(False)) & confident)


def _minutes(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 60 + int(minutes)


def in_quiet_hours(
    ts: Column,
    start: str = fixed.QUIET_START,
    end: str = fixed.QUIET_END,
    zone: str = "UTC",
) -> Column:
    """Whether local time lies in [start, end); the span may wrap midnight."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    first, last = _minutes(start), _minutes(end)
    after, before = minute >= first, minute < last
    return (after & before) if first <= last else (after | before)


def route_status(score: Column, notify: Column, quiet: Column) -> Column:
    return (
        F.when(~F.coalesce(notify, F.lit(False)), "suppressed")
        .when(quiet & (score < fixed.QUIET_OVERRIDE_SCORE), "digest_pending")
        .otherwise("new")
    )


def route_queue(status: Column) -> Column:
    return F.when(status == "digest_pending", "digest").when(status == "new", "notify")


def intent_label(intent: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in fixed.INTENT_LABELS.items():
        label = F.when(intent == name, text).otherwise(label)
    return F.coalesce(label, intent)


def precision(good: Column, bad: Column) -> Column:
    """good / (good + bad); null without feedback."""
    return F.try_divide(good.cast("double"), (good + bad).cast("double"))
