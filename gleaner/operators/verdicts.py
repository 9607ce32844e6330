"""Classifier hand-over: work list out, verdicts in, rules as the fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import decisions
from gleaner.rules import RuleSet

Classifier = Callable[[DataFrame], DataFrame]


def work_list(decided: DataFrame) -> DataFrame:
    """(id, circuit, mode, rule_hint, prompt_variant, item_text) of items to be classified."""
    return decided.filter(F.col("mode").isNotNull()).select(
        "id",
        "circuit",
        "mode",
        "rule_hint",
        decisions.prompt_variant(F.col("circuit")).alias("prompt_variant"),
        decisions.classifier_text(F.col("source"), F.col("title"), F.col("text")).alias("item_text"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses (id, response) as verdict rows: outcome ok with a verdict, or error."""
    parsed = responses.withColumn("verdict", decisions.parse_verdict(F.col("response")))
    return parsed.withColumn(
        "outcome", F.when(F.col("verdict").isNotNull(), "ok").otherwise("error")
    )


def apply_verdicts(decided: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final state of decided items (id, score, mode, rules_notify, intent_tag, ...).

    ``verdicts`` has id, outcome (ok, quota_exhausted, error) and verdict.  Items without a mode
    are decided by the rules; items still without a row stay pending.
    """
    joined = decided.join(verdicts.select("id", "outcome", "verdict"), "id", "left")
    outcome, verdict = F.col("outcome"), F.col("verdict")
    asked = F.col("mode").isNotNull()
    answered = asked & (outcome == "ok")
    notify = (
        F.when(~asked, F.col("rules_notify"))
        .when(answered, decisions.verdict_notifies(F.col("mode"), verdict))
        .when(outcome.isNotNull(), F.col("rules_notify"))
    )
    return joined.withColumns(
        {
            "decided_by": F.when(~asked, "rules")
            .when(answered, "llm")
            .when(outcome.isNotNull(), "rules_only")
            .otherwise("rules"),
            "llm_status": F.when(~asked, "not_needed")
            .when(outcome.isNull(), "pending")
            .when(outcome == "ok", "done")
            .when(outcome == "quota_exhausted", "skipped_quota")
            .otherwise("failed"),
            "intent_tag": F.when(
                answered & verdict["lead_type"].isin("hiring_intent", "pain_point"),
                verdict["lead_type"],
            ).otherwise(F.col("intent_tag")),
            "llm_summary_ru": F.when(answered, verdict["summary_ru"]),
            "llm_prob": F.when(answered, F.coalesce(verdict["confidence"], F.lit(0.0))),
            "will_notify": notify,
        }
    ).withColumnsRenamed({"verdict": "llm_verdict"}).drop("outcome")


def route_items(final: DataFrame, at: str | Column = "ts", zone: str = "UTC") -> DataFrame:
    """Add status and queue; items that wait for a verdict keep status awaiting_llm.

    ``at`` is the moment of the decision: a column of the items, or one moment for all.
    """
    moment = F.col(at) if isinstance(at, str) else at
    status = F.when(F.col("llm_status") == "pending", "awaiting_llm").otherwise(
        decisions.route_status(
            F.col("score"),
            F.col("will_notify"),
            decisions.in_quiet_hours(moment, zone=zone),
        )
    )
    return final.withColumn("status", status).withColumn(
        "queue", decisions.route_queue(F.col("status"))
    )


def judge_stored(
    matches: DataFrame,
    verdicts: DataFrame,
    now: Column,
    rules: RuleSet,
    zone: str = "UTC",
) -> DataFrame:
    """Stored matches (with ``mode``) after verdict rows have come in.

    Rows that wait and have a verdict now get their final state, and route at the moment ``now``; all others stay as they are.  ``verdicts`` is as ``parse_responses`` gives it.
    """
    waiting = (F.col("llm_status") == "pending") & F.col("mode").isNotNull()
    names = [c for c in matches.columns if c not in ("queue", "will_notify", "rules_notify")]
    open_rows = matches.filter(F.coalesce(waiting, F.lit(False)))
    answered = open_rows.join(verdicts.select("id"), "id", "left_semi")
    state = ["decided_by", "llm_status", "llm_verdict", "llm_summary_ru", "llm_prob"]
    decided = answered.drop(*state, "status", "queue", "will_notify").withColumn(
        "rules_notify", F.col("score") >= rules.notify_threshold
    )
    judged = route_items(apply_verdicts(decided, verdicts), now, zone)
    untouched = matches.join(answered.select("id"), "id", "left_anti")
    return untouched.select(*names).unionByName(judged.select(*names))


def classify(decided: DataFrame, classifier: Classifier) -> DataFrame:
    """Run a batch classifier over the work list and apply what it returns.

    ``classifier`` takes the work list and returns (id, response) rows.
    """
    return apply_verdicts(decided, parse_responses(classifier(work_list(decided))))
