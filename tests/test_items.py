import datetime as dt

from pyspark.sql import functions as F
import pytest

from gleaner import schemas
from gleaner.operators import flow, items, reports, verdicts
from gleaner.rules import (
    dictionary_listing, load_rules, rule_set, seed_keywords, seed_rule_weights, seed_rules, seed_sources,
)

RULES = seed_rules()
FEED = "id bigint, title string, body string, has_body boolean, tag string, source string, circuit string"
FILL = " and some more plain words that say nothing at all about it"


def judged(spark, rows, rules=RULES):
    frame = spark.createDataFrame(rows, FEED)
    matched = items.match_items(items.normalize_items(frame, rules), rules)
    found = items.reject_items(matched, rules).select("id", "reject_rule").collect()
    return {r.id: r.reject_rule for r in found}


def test_full_score(spark):
    row = (
        1,
        "[Hiring] Need a developer for a web scraper",
        "We need a developer to build a python scraper. Budget is $500. Email me@x.io",
        True,
        "hiring",
        "board",
        "main",
    )
    frame = spark.createDataFrame([row], FEED).withColumns(
        {"category": F.lit("job_board"), "priority": F.lit(3), "author_bonus": F.lit(0)}
    )
    matched = items.match_items(items.normalize_items(frame, RULES), RULES)
    scored = items.decide_items(items.score_items(items.reject_items(matched, RULES), RULES), RULES)
    got = scored.first()
    assert got.signals == {
        "stack": 6, "intent": 6, "has_contact": 2, "has_money_pattern": 3, "short_len": -3,
        "help_question": 2, "tag_hiring": 6, "category_job_board": 3, "source_priority": 3,
    }
    assert got.score == 28 == sum(got.signals.values())
    assert got.struct_features.length == 121
    assert got.intent_tag == "hiring_intent"
    assert sorted(got.terms.stack) == ["python", "scraper"] and got.terms.stack[0] == "scraper"
    assert (got.contact, got.compensation) == ("me@x.io", "budget is")
    assert got.reject_rule is None and got.mode == "classify_and_translate" and got.rules_notify
    assert got.rule_hint == "балл правил 28 при пороге уведомления 10"


def test_gates(spark):
    offer = "need a developer" + FILL * 4
    cases = {
        "HF-1_length": ("x" * 39, "", True, None, "main"),
        "HF-2_no_signal": ("n" + FILL, "", True, None, "main"),
        None: ("n" + FILL, "", True, None, "browse"),
        "HF-3_closed": ("need a developer, update: found" + FILL, "", True, None, "main"),
        "HF-4_low_info": ("t" + FILL, "", True, "hiring", "main"),
        "HF-5_service_offer": (offer, "", True, "for hire", "main"),
        "HF-6_no_body": ("keeps breaking" + FILL, "", False, None, "main"),
    }
    rows = [
        (i, title, body, has_body, tag, "s", circuit)
        for i, (title, body, has_body, tag, circuit) in enumerate(cases.values())
    ]
    rows += [
        (20, "word " * 4000 + "x", "", True, None, "s", "main"),
        (21, "need a developer" + FILL, "", False, None, "s", "main"),
        (22, "x" * 40, "", True, None, "s", "browse"),
    ]
    got = judged(spark, rows)
    assert [got[i] for i in range(len(cases))] == list(cases)
    assert got[20] == "HF-1_length" and got[21] is None and got[22] is None


def test_closed_near_hiring(spark):
    far, gap = "word " * 180, "word " * 3
    close = far + "solved " + gap + "need a developer"
    apart = far + "solved " + "word " * 50 + "need a developer"
    got = judged(spark, [(1, close, "", True, None, "s", "main"), (2, apart, "", True, None, "s", "main")])
    assert got == {1: "HF-3_closed", 2: None}


def test_offer_position(spark):
    lead = "need a developer "
    at_299 = lead + "y" * (299 - len(lead) - 1) + " hire me" + FILL
    at_300 = lead + "y" * (300 - len(lead) - 1) + " hire me" + FILL
    got = judged(spark, [(1, at_299, "", True, None, "s", "main"), (2, at_300, "", True, None, "s", "main")])
    assert got == {1: "HF-5_service_offer", 2: None}


def test_noise_cap_and_veto(spark):
    row = (1, "python scraper: check out my case study, i built it, free trial" + FILL, "", True, None, "s", "main")
    frame = spark.createDataFrame([row], FEED).withColumns(
        {"category": F.lit("other"), "priority": F.lit(0), "author_bonus": F.lit(0)}
    )
    got = items.score_items(items.match_items(items.normalize_items(frame, RULES), RULES), RULES).first()
    assert got.signals["noise"] == -8 and got.help_request is False and got.intent_tag == "unknown"


def test_zero_weight_rules_stay_visible(spark):
    rules = rule_set([], [("no_stack", 0), ("short_len", 0)])
    frame = spark.createDataFrame([(1, "hello", "", True, None, "s", "main")], FEED).withColumns(
        {"category": F.lit("other"), "priority": F.lit(0), "author_bonus": F.lit(0)}
    )
    got = items.score_items(items.match_items(items.normalize_items(frame, rules), rules), rules).first()
    assert got.signals == {"no_stack": 0, "short_len": 0} and got.score == 0


def test_rule_loading(spark):
    loaded = load_rules(seed_keywords(spark), seed_rule_weights(spark))
    assert loaded.stack == RULES.stack and loaded.weights == RULES.weights
    assert loaded.patterns["noise"] is not None and loaded.aliases == RULES.aliases
    assert loaded.notify_threshold == 10
    rows = [
        ("stack_periph", "sql", 1, None, True), ("stack_core", "sql", 3, None, True),
        ("noise", "off", -4, None, False), ("alias", "x", 0, None, True),
    ]
    few = load_rules(
        spark.createDataFrame(rows, schemas.KEYWORDS),
        spark.createDataFrame([("__notify_threshold__", 4), ("short_len", -1)], schemas.RULE_WEIGHTS),
    )
    assert few.stack == {"sql": 3} and not few.noise and not few.aliases
    assert few.notify_threshold == 4 and few.weight("short_len") == -1
    assert seed_sources(spark).count() == 20
    assert dictionary_listing(seed_keywords(spark)).filter("dict_type = 'alias'").first().terms == 24


def test_author_bonus(spark):
    authors = spark.createDataFrame([("a", 3, 9), ("b", 0, 5), ("c", 1, 5)], schemas.AUTHORS)
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "author_handle string")
    got = {r.author_handle: r.author_bonus for r in items.with_author_bonus(rows, authors, RULES).collect()}
    assert got == {"a": 2, "b": -5, "c": 0, "d": 0, None: 0}


def test_source_gate(spark):
    now = dt.datetime(2024, 1, 2)
    rows = [
        ("Board", "job_board", "main", True, None, 3, None, None),
        ("off", "other", "main", False, None, 0, None, None),
        ("quiet", "other", "browse", True, dt.datetime(2024, 1, 3), 0, None, None),
        ("awake", "other", "browse", True, dt.datetime(2024, 1, 1), 0, None, None),
    ]
    sources = spark.createDataFrame(rows, schemas.SOURCES)
    feed = spark.createDataFrame([("board",), ("off",), ("quiet",), ("awake",), ("new",)], "source string")
    got = {tuple(r) for r in items.source_gate(feed, sources, F.lit(now)).collect()}
    assert got == {
        ("Board", "main", "job_board", 3), ("awake", "browse", "other", 0), ("new", "main", "other", 0),
    }


def test_verdicts(spark):
    decided = spark.createDataFrame(
        [
            (1, 12, "both", "classify_and_translate", True, "2024-01-01 12:00:00"),
            (2, 12, "both", "classify_and_translate", True, "2024-01-01 12:00:00"),
            (3, 4, "both", "translate", False, "2024-01-01 12:00:00"),
            (4, 12, "both", "classify_and_translate", True, "2024-01-01 23:30:00"),
            (5, 4, "both", "classify_and_translate", False, "2024-01-01 12:00:00"),
            (6, 15, "both", None, True, "2024-01-01 23:30:00"),
            (7, 15, "both", "classify_and_translate", True, "2024-01-01 12:00:00"),
        ],
        "id bigint, score int, intent_tag string, mode string, rules_notify boolean, at string",
    ).withColumn("ts", F.to_timestamp("at"))

    def classifier(work):
        answers = {
            1: '{"is_lead": true, "confidence": 0.55, "lead_type": "pain_point", "summary_ru": "s"}',
            2: '{"is_lead": true, "confidence": 0.54}',
            3: '{"is_lead": false}',
            4: "broken",
            5: "broken",
        }
        asked = work.select("id")
        given = spark.createDataFrame(list(answers.items()), "id bigint, response string")
        return asked.join(given, "id")

    decided = decided.withColumns({"circuit": F.lit("main"), "source": F.lit("s"), "title": F.lit("t"), "text": F.lit("x"), "rule_hint": F.lit("")})
    final = verdicts.route_items(verdicts.classify(decided, classifier))
    got = {r.id: (r.decided_by, r.llm_status, r.status, r.intent_tag) for r in final.collect()}
    assert got == {
        1: ("llm", "done", "new", "pain_point"),
        2: ("llm", "done", "suppressed", "both"),
        3: ("llm", "done", "new", "both"),
        4: ("rules_only", "failed", "digest_pending", "both"),
        5: ("rules_only", "failed", "suppressed", "both"),
        6: ("rules", "not_needed", "new", "both"),
        7: ("rules", "pending", "awaiting_llm", "both"),
    }


def test_silence(spark):
    beats = spark.createDataFrame(
        [("main", "2024-01-01 10:00:00", 1), ("browse", "2024-01-01 10:14:00", 2)],
        "circuit string, at string, id bigint",
    ).withColumn("ts", F.to_timestamp("at"))
    monitored = spark.createDataFrame([("main",), ("browse",), ("third",)], "circuit string")
    now = F.to_timestamp(F.lit("2024-01-01 10:15:01"))
    got = {r.circuit: r.silent_seconds for r in reports.silent_circuits(monitored, beats, now).collect()}
    assert got == {"main": 901, "third": None}


def test_flow_keeps_rejected_items_and_matches_the_rest(spark):
    text = "[Hiring] need a developer for a python scraper and a website, budget is $500"
    rows = [
        (1, "1", text, "b", True, "hiring", "s1", "bob"),
        (2, "2", text, "b", True, "hiring", "s1", "eve"),
        (3, "3", "nothing to see here, move along please, thank you", "b", True, None, "s1", "bob"),
    ]
    feed = spark.createDataFrame(
        rows,
        "id bigint, item_id string, title string, body string, has_body boolean, tag string, source string, author_handle string",
    ).withColumns(
        {"ts": F.timestamp_seconds(F.lit(1704100000) + F.col("id")), "posted_at": F.lit(dt.datetime(2024, 1, 1)), "permalink": F.lit("u")}
    )
    authors = spark.createDataFrame([("bob", 3, 0)], schemas.AUTHORS)
    got = flow.process(feed, seed_sources(spark), authors, RULES, F.current_timestamp(), classifier_on=False)
    assert {r.id: (r.reject_rule, r.duplicate_of) for r in got.raw_items.collect()} == {
        1: (None, None), 2: ("duplicate", 1), 3: ("HF-2_no_signal", None),
    }
    (match,) = got.matches.collect()
    assert match.raw_item_id == 1 and match.score == sum(match.signals.values())
    assert match.signals["author_reputation"] == 2 and match.status == "new" and match.queue == "notify"


def test_first_seen_is_not_renewed(spark):
    from gleaner.operators import admin

    days = [0, 5, 8, 14, 15, 15, 16]
    rows = [(i, "a", d * 86_400) for i, d in enumerate(days)] + [(10, "b", 7 * 86_400), (11, "b", 14 * 86_400), (12, "b", 14 * 86_400 + 1)]
    events = spark.createDataFrame(rows, "id bigint, item_id string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.id: r.is_first for r in admin.first_seen(events, days=7).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 10: True, 11: False, 12: True}


def test_insert_if_absent_takes_the_first(spark):
    from gleaner.operators import admin

    table = spark.createDataFrame([("a", 1, 0)], "name string, weight int, n int")
    rows = spark.createDataFrame([("b", 9, 2), ("b", 5, 1), ("a", 7, 3), ("c", 4, 4)], "name string, weight int, n int")
    got = sorted(tuple(r) for r in admin.insert_if_absent(table, rows, ["name"], ["n"]).collect())
    assert got == [("a", 1, 0), ("b", 5, 1), ("c", 4, 4)]


def test_verdicts_over_stored_matches(spark):
    from gleaner import schemas
    from gleaner.rules import seed_rules

    matches = spark.createDataFrame(
        [(1, 12, "both", "classify_and_translate", "pending", "awaiting_llm"), (2, 12, "both", "classify_and_translate", "pending", "awaiting_llm"),
         (3, 15, "both", None, "not_needed", "new"), (4, 12, "both", "classify_and_translate", "pending", "awaiting_llm")],
        "id bigint, score int, intent_tag string, mode string, llm_status string, status string",
    ).withColumns({"decided_by": F.lit("rules"), "llm_verdict": F.lit(None).cast(schemas.VERDICT), "llm_summary_ru": F.lit(None).cast("string"), "llm_prob": F.lit(None).cast("double")})
    answers = spark.createDataFrame([(1, '{"is_lead": 1, "confidence": "0.9", "summary_ru": "s"}'), (2, "broken")], "id bigint, response string")
    night = F.to_timestamp(F.lit("2024-01-01 23:30:00"))
    judged = verdicts.judge_stored(matches, verdicts.parse_responses(answers), night, seed_rules())
    got = {r.id: (r.decided_by, r.llm_status, r.status) for r in judged.collect()}
    assert got == {
        1: ("llm", "done", "digest_pending"),
        2: ("rules_only", "failed", "digest_pending"),
        3: ("rules", "not_needed", "new"),
        4: ("rules", "pending", "awaiting_llm"),
    }
    assert judged.columns == matches.columns
