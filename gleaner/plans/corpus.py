"""The monitored-feed tables as views over the general test tables.

Each function derives one table from whole input tables; the DuckDB text in ``plans.oracle``
derives the same rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions.text import extract_tag, headline
from gleaner.rules import RuleSet, rule_set
from gleaner.session import SMALL_TABLE_BYTES, bound_arrow_batches

START = "2024-01-01 00:00:00"
SPREAD = 16
HELP_WORDS = r"\bthan the\b|\bis there\b|\bfrom\b"

# A dictionary of words that the test documents hold.
KEYWORD_ROWS = [
    ("stack_core", "thing", 3, None),
    ("stack_core", "attion", 3, None),
    ("stack_core", "retion", 3, None),
    ("stack_periph", "tion", 1, None),
    ("stack_periph", "ther", 1, None),
    ("hiring_intent", "thanedble", 4, None),
    ("hiring_intent", "then", 2, None),
    ("hiring_intent", "zque", 4, None),
    ("pain_point", "eror", 3, None),
    ("pain_point", "onor", 3, None),
    ("money", "from", 2, None),
    ("noise", "zen", -4, None),
    ("noise", "onwh", -5, None),
    ("anti", "ansh", 0, None),
    ("anti", "sich", 0, None),
    ("closed", "heat", 0, None),
    ("closed", "une", 0, None),
    ("alias", "thly", 0, "thing"),
]


# What the test documents lack, by remainder of the document number: (modulus, remainder, text).
TITLE_LABELS = [(40, 0, "[Hiring] "), (40, 13, "[Task] "), (40, 27, "[For Hire] ")]
SHORT_LABEL = "[Hiring] "  # on every second short text without another label: (characters below)
SHORT_TEXT = 140
TITLE_ENDS = [(19, 6, " or not?")]
BODY_ENDS = [
    (11, 3, "\nDeliverables: reports\n- one\n- two\n3. three"),
    (13, 4, "\nWe pay $500 for it"),
    (17, 5, "\nmore at https://example.test/x"),
    (23, 7, "\na budget of some kind"),
]
MINUTES_BETWEEN_ITEMS = 97


def short_label(number: Column, text: Column) -> Column:
    labelled = [number % m == r for m, r, _ in TITLE_LABELS]
    plain = ~functools.reduce(Column.__or__, labelled)
    return F.when(plain & (number % 2 == 1) & (F.length(text) < SHORT_TEXT), SHORT_LABEL).otherwise("")


def added(number: Column, table: list[tuple[int, int, str]]) -> Column:
    parts = [F.when(number % m == r, text).otherwise("") for m, r, text in table]
    return F.concat(*parts)


def corpus_rules(**limits) -> RuleSet:
    return rule_set(KEYWORD_ROWS, fixed.RULE_WEIGHTS.items(), help_pattern=HELP_WORDS, **limits)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its times without a zone are read in the session's zone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with long texts; one below ``SMALL_TABLE_BYTES`` is spread over more tasks first.

    Such a table is a file or two, and text work on it would run in as many tasks.  Larger tables
    are read as they are, however many cores there are.
    """
    bound_arrow_batches(spark)
    df = table(spark, folder, name)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(SPREAD) if size <= SMALL_TABLE_BYTES else df


def minutes_after_start(minutes: Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(F.to_timestamp(F.lit(START))) + minutes.cast("bigint") * 60_000_000
    )


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """documents as feed items: first line = title, rest = body, with the additions above."""
    docs = texts(spark, folder, "documents")
    cut = F.instr("text", "\n")
    n = F.col("doc_id")
    title = F.concat(
        added(n, TITLE_LABELS),
        short_label(n, F.col("text")),
        F.when(cut > 0, F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text")),
        added(n, TITLE_ENDS),
    )
    body = F.concat(
        F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text"))).otherwise(""),
        added(n, BODY_ENDS),
    )
    moment = minutes_after_start(n * MINUTES_BETWEEN_ITEMS)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("item_id"),
        "source",
        title.alias("title"),
        body.alias("body"),
        ((cut > 0) | (added(n, BODY_ENDS) != "")).alias("has_body"),
        extract_tag(title).alias("tag"),
        F.concat(F.lit("user"), (F.col("doc_id") % 50).cast("string")).alias("author_handle"),
        F.concat(F.lit("https://example.test/"), F.col("doc_id").cast("string")).alias("permalink"),
        moment.alias("posted_at"),
        moment.alias("created_at"),
        moment.alias("ts"),
    )


def sources(spark: SparkSession, folder: str, all_enabled: bool = False) -> DataFrame:
    """Distinct document sources; every 7th disabled, every 5th in the browse circuit."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    names = table(spark, folder, "documents").select("source").distinct()
    return names.select(
        F.upper("source").alias("name"),
        F.element_at(F.array(*map(F.lit, fixed.CATEGORIES)), number % 8 + 1).alias("category"),
        F.when(number % 5 == 0, "browse").otherwise("main").alias("circuit"),
        (F.lit(True) if all_enabled else number % 7 != 6).alias("enabled"),
        F.when(number % 6 == 1, minutes_after_start(number * 100)).alias("muted_until"),
        (number % 4).alias("priority"),
        F.lit(None).cast("timestamp").alias("added_at"),
        F.lit(None).cast("timestamp").alias("last_seen_at"),
    )


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """One match per document, with scores, statuses and times computed from the document."""
    docs = table(spark, folder, "documents")
    n = F.col("doc_id")
    intents = ["hiring_intent", "pain_point", "both", "help_request", "unknown"]
    status = (
        F.when(n % 8 == 5, "suppressed").when(n % 8 == 6, "digest_pending").when(n % 8 == 7, "new")
        .otherwise("notified")
    )
    created = minutes_after_start(F.floor(n / 3) * 3)
    return docs.select(
        n.alias("id"),
        n.alias("raw_item_id"),
        F.when(n % 5 == 0, "browse").otherwise("main").alias("circuit"),
        (F.col("n_chars") % 30).cast("int").alias("score"),
        F.element_at(F.array(*map(F.lit, intents)), (n % 5 + 1).cast("int")).alias("intent_tag"),
        headline(F.element_at(F.split("text", "\n"), 1)).alias("headline"),
        F.when(n % 3 == 0, F.concat(F.lit("s "), F.col("lang"))).alias(
            "llm_summary_ru"
        ),
        F.when(n % 4 == 0, F.concat((n % 100).cast("string"), F.lit(" usd"))).alias("compensation"),
        F.when(n % 6 == 0, "rules_only").otherwise("rules").alias("decided_by"),
        F.when(n % 6 == 0, "failed").otherwise("not_needed").alias("llm_status"),
        (n % 3).cast("int").alias("duplicate_count"),
        (n % 10 == 0).alias("is_favorite"),
        status.alias("status"),
        F.when(status == "notified", minutes_after_start(n + 5)).alias("notified_at"),
        created.alias("created_at"),
    )


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stored items, without the rule columns."""
    docs = table(spark, folder, "documents")
    n = F.col("doc_id")
    reject = F.when(n % 4 == 1, "HF-2_no_signal").when(n % 4 == 2, "duplicate")
    return docs.select(
        n.alias("id"),
        "source",
        F.when(n % 5 == 0, "browse").otherwise("main").alias("circuit"),
        n.cast("string").alias("item_id"),
        F.concat(F.lit("user"), (n % 50).cast("string")).alias("author_handle"),
        F.concat(F.lit("https://example.test/"), n.cast("string")).alias("permalink"),
        F.split("text", "\n")[0].alias("title"),
        "text",
        minutes_after_start(n).alias("posted_at"),
        reject.alias("reject_rule"),
        minutes_after_start(n).alias("created_at"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Votes from the labels; some authors get bad votes only, some none (see the 50 handles)."""
    n = F.col("doc_id")
    labels = table(spark, folder, "labels").filter(n % 10 != 8)
    bad = (F.col("quality") == 0) | (n % 10 == 7)
    reasons = F.array(*map(F.lit, fixed.FEEDBACK_REASONS))
    return labels.select(
        n.alias("id"),
        n.alias("match_id"),
        F.when(bad, "bad").otherwise("good").alias("verdict"),
        F.when(bad, F.element_at(reasons, (n % 8 + 1).cast("int"))).alias("reason"),
        minutes_after_start(n).alias("created_at"),
    )


def usage_log(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("match_id"),
        F.when(F.col("user_id") % 2 == 0, "main").otherwise("browse").alias("circuit"),
        F.when(kind == "error", "error").when(kind == "signup", "quota_exhausted").otherwise("ok").alias(
            "outcome"
        ),
        F.col("value").cast("bigint").alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )


def numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    """events with the number k of their JSON properties, read once per row."""
    number = F.from_json("props", "k INT")["k"]
    return table(spark, folder, "events").withColumn("k", number)


def crm_commands(spark: SparkSession, folder: str) -> DataFrame:
    """events as CRM commands on the match with the user's number."""
    events = numbered_events(spark, folder)
    kind, n, k = F.col("event_type"), F.col("event_id"), F.col("k")
    return events.select(
        n.alias("cmd_id"),
        "ts",
        F.col("user_id").alias("match_id"),
        F.when(kind.isin("view", "click"), "contact")
        .when(kind == "purchase", "response")
        .when(kind == "signup", "earnings")
        .when((kind == "error") & (k % 25 == 0), "delete")
        .otherwise("response")
        .alias("kind"),
        F.when(kind == "view", F.when(k % 40 == 0, "not_contacted").otherwise("postponed"))
        .when(kind == "click", "contacted")
        .alias("contact_state"),
        F.when(k % 30 == 7, "").otherwise(F.concat(F.lit("reply "), k.cast("string"))).alias(
            "response_text"
        ),
        F.when(kind == "purchase", "true")
        .when(k % 3 == 0, "false")
        .when(k % 3 == 1, "null")
        .otherwise("")
        .alias("taken_in_work"),
        F.when(k % 50 == 3, "-1").otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias(
            "earnings"
        ),
        F.when(k % 45 == 4, "usd").when(k % 4 == 1, "EUR").when(k % 4 == 2, None).otherwise("GBP").alias(
            "currency"
        ),
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("circuit"),
        "ts",
        F.col("event_id").alias("id"),
        "value",
    )


def keyword_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as keyword commands: errors disable a term, the rest add or re-weight it."""
    kinds = F.array(*map(F.lit, [*fixed.DICT_TYPES, "slang"]))
    k = F.col("k")
    return numbered_events(spark, folder).select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(F.col("event_type") == "error", "del").otherwise("add").alias("action"),
        F.element_at(kinds, (F.col("user_id") % 10 + 1).cast("int")).alias("dict_type"),
        F.concat(F.lit("Term "), k.cast("string")).alias("term"),
        F.when(F.col("event_type") != "view", (k % 9 - 4)).cast("int").alias("weight"),
    )
