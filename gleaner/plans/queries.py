"""Registered queries: each operator over whole test tables, with plain comparable columns."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner import rules as rule_tables
from gleaner import schemas
from gleaner.functions import decisions, gates, hashing, scoring, text
from gleaner.operators import admin, crm, dedup, flow, items, quota, reports, verdicts
from gleaner.plans import corpus
from gleaner.session import cut_lineage, shared_folder
from gleaner.sources import atom, messages, sinks
from gleaner.streaming import ingest, jobs, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def at(moment: str) -> Column:
    return F.to_timestamp(F.lit(moment))


NOW = "2024-01-01 09:00:00"
SINCE = "2024-01-01 05:00:00"
RULES = corpus.corpus_rules()


def plain(df: DataFrame) -> DataFrame:
    """Columns as long, double, boolean or string, so that any engine compares them alike."""
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind in ("tinyint", "smallint", "int"):
            value = value.cast("bigint")
        elif kind.startswith("decimal"):
            value = value.cast("string")
        elif kind == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("array"):
            value = F.array_join(value, ",")
        columns.append(value.alias(name))
    return df.select(*columns)


def register(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(query(spark, folder))

    QUERIES[query.__name__] = run
    return query


# --- texts ---------------------------------------------------------------------------------


def _feed(spark, folder):
    return corpus.feed_items(spark, folder)


def _norm(spark, folder):
    return items.normalize_items(_feed(spark, folder), RULES)


def _placed(spark, folder):
    return items.source_gate(
        _feed(spark, folder), corpus.sources(spark, folder), at(NOW), drop_blocked=False
    )


def _matched(spark, folder):
    return items.match_items(items.normalize_items(_placed(spark, folder), RULES), RULES)


@register
def raw_text(spark, folder):
    df = _feed(spark, folder)
    return df.select("id", text.raw_text(F.col("title"), F.col("body")).alias("text"))


@register
def extract_tag(spark, folder):
    return _feed(spark, folder).select("id", text.extract_tag(F.col("title")).alias("tag"))


@register
def struct_features(spark, folder):
    return _norm(spark, folder).select("id", "struct_features.*")


@register
def normalize_text(spark, folder):
    df = _norm(spark, folder)
    return df.select("id", text.normalize_text(F.col("text")).alias("text_norm"))


@register
def apply_aliases(spark, folder):
    return _norm(spark, folder).select("id", "text_norm")


@register
def headline(spark, folder):
    return _feed(spark, folder).select("id", text.headline(F.col("title")).alias("headline"))


@register
def matched_terms(spark, folder):
    df = _matched(spark, folder)
    return df.select(
        "id", *[F.sort_array(f"terms.{kind}").alias(kind) for kind in items.TERM_KINDS]
    )


@register
def match_positions(spark, folder):
    df = _norm(spark, folder)
    found = text.match_positions(F.col("text_norm"), RULES.patterns["stack"])
    return df.select("id", found.alias("positions"))


@register
def near_positions(spark, folder):
    """First closing and first hiring word of each text, as token numbers, and whether near."""
    df = _norm(spark, folder)
    first = {
        kind: F.try_element_at(
            text.match_positions(F.col("text_norm"), RULES.patterns[kind]), F.lit(1)
        )
        for kind in ("closed", "hiring")
    }
    df = df.select("id", "text_norm", *[p.alias(k) for k, p in first.items()])
    return df.select(
        "id",
        *[text.token_index(F.col("text_norm"), F.col(k)).alias(f"{k}_token") for k in first],
        text.near(F.col("text_norm"), F.col("closed"), F.col("hiring"), 6).alias("is_near"),
    )


@register
def contact_extract(spark, folder):
    return _norm(spark, folder).select("id", scoring.contact(F.col("text_norm")).alias("contact"))


@register
def compensation_extract(spark, folder):
    """Amounts are rare in documents, so each conversation text is asked as well."""
    docs = _norm(spark, folder).select(F.col("text_norm").alias("t"), "id", F.lit("doc").alias("kind"))
    turns = corpus.texts(spark, folder, "conversations").select(
        text.normalize_text(F.col("text")).alias("t"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit("turn").alias("kind"),
    )
    return docs.unionByName(turns).select(
        "kind", "id", scoring.compensation(F.col("t")).alias("compensation")
    )


@register
def section_headers(spark, folder):
    return _norm(spark, folder).select("id", scoring.has_sections(F.col("text_norm")).alias("found"))


@register
def body_extract(spark, folder):
    pages = corpus.texts(spark, folder, "pages")
    body = text.extract_body(F.col("html"), "<article>", "</article>")
    return pages.select("page_id", body.alias("b")).select("page_id", "b.*")


# --- hashes and duplicates -----------------------------------------------------------------


@register
def text_hash(spark, folder):
    return _norm(spark, folder).select("id", hashing.text_hash(F.col("text_norm")).alias("hash"))


@register
def simhash_md5(spark, folder):
    return _norm(spark, folder).select(
        "id", hashing.simhash64(F.col("text_norm"), "md5").alias("simhash")
    )


@register
def simhash_bands(spark, folder):
    df = simhash_md5(spark, folder)
    return df.select("id", F.posexplode(hashing.bands(F.col("simhash"))).alias("band", "value"))


@register
def simhash_unsigned(spark, folder):
    df = simhash_md5(spark, folder).withColumn(
        "unsigned", hashing.to_unsigned64(F.col("simhash"))
    )
    return df.select("id", "unsigned", hashing.to_signed64(F.col("unsigned")).alias("signed"))


def _keys(spark, folder):
    """Hash columns of all items as a stored table: several branches of a plan read them."""
    hashed = items.hash_items(_norm(spark, folder), "md5")
    return cut_lineage(hashed.select("id", "ts", "text_hash", "simhash"))


@register
def exact_dups(spark, folder):
    return dedup.exact_originals(_keys(spark, folder))


@register
def near_dups(spark, folder):
    keys = _keys(spark, folder)
    found = dedup.near_originals(keys)
    own = keys.select("id", F.col("simhash").alias("a"))
    other = keys.select(F.col("id").alias("original"), F.col("simhash").alias("b"))
    joined = found.join(own, "id").join(other, "original")
    return joined.select(
        "id", "original", hashing.hamming(F.col("a"), F.col("b")).alias("distance")
    )


@register
def all_dups(spark, folder):
    return dedup.originals(_keys(spark, folder))


@register
def dup_counts(spark, folder):
    found = dedup.originals(_keys(spark, folder))
    return dedup.duplicate_counts(found, corpus.matches(spark, folder))


# --- gates and scores ----------------------------------------------------------------------


@register
def help_request(spark, folder):
    return _matched(spark, folder).select("id", "help_request")


@register
def hf_each(spark, folder):
    """Every gate on its own, without the order of the chain."""
    df = _matched(spark, folder)
    norm, terms, tag = F.col("text_norm"), F.col("terms"), F.col("tag")
    helped, skip = F.col("help_request"), F.col("circuit") != "main"
    return df.select(
        "id",
        gates.length_gate(norm).alias("hf1"),
        gates.signal_gate(terms, tag, helped, skip).alias("hf2"),
        gates.closed_gate(norm, terms["hiring"], RULES).alias("hf3"),
        gates.low_info_gate(norm, terms, helped, skip).alias("hf4"),
        gates.offer_gate(norm, tag, RULES).alias("hf5"),
        gates.body_gate(F.col("has_body"), terms["hiring"], tag).alias("hf6"),
    )


@register
def hf_chain(spark, folder):
    return items.reject_items(_matched(spark, folder), RULES).select("id", "circuit", "reject_rule")


def _replayed(spark, folder, soft_help=True):
    return items.dry_run(
        _feed(spark, folder), corpus.sources(spark, folder), RULES, soft_help=soft_help
    )


@register
def reject_counts(spark, folder):
    return items.reject_counts(_replayed(spark, folder))


@register
def dry_run_summary(spark, folder):
    return items.dry_run_summary(_replayed(spark, folder), RULES)


@register
def dry_run_without_help(spark, folder):
    return items.dry_run_summary(_replayed(spark, folder, soft_help=False), RULES)


@register
def passed_by_intent(spark, folder):
    return items.passed_by_intent(_replayed(spark, folder))


@register
def top_candidates(spark, folder):
    fired = F.array_sort(F.map_entries("signals"))
    named = F.transform(fired, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return items.top_candidates(_replayed(spark, folder)).withColumn("signals", named)


@register
def translate_set(spark, folder):
    """Items to notify but not to classify, under a rule set that asks for high help scores."""
    strict = corpus.corpus_rules(help_min_score=100)
    replayed = items.dry_run(_feed(spark, folder), corpus.sources(spark, folder), strict)
    slim = replayed.select("id", "reject_rule", "score", "intent_tag")
    return items.translate_only(cut_lineage(slim), strict).select("id", "score")


@register
def last_items(spark, folder):
    raw = corpus.raw_items(spark, folder)
    return items.last_items(raw, 100).select("id", "created_at")


@register
def score_layers(spark, folder):
    terms = F.col("terms")
    return _matched(spark, folder).select(
        "id",
        scoring.stack_points(terms["stack"], RULES).alias("stack"),
        scoring.intent_points(terms["hiring"], terms["pain"], terms["money"], RULES).alias("intent"),
        scoring.noise_points(terms["noise"], RULES).alias("noise"),
    )


@register
def score_total(spark, folder):
    return _replayed(spark, folder).select("id", "score", F.size("signals").alias("fired"))


@register
def signals_explode(spark, folder):
    return reports.score_explanation(_replayed(spark, folder))


@register
def intent_tags(spark, folder):
    return _replayed(spark, folder).select(
        "id", "intent_tag", decisions.intent_label(F.col("intent_tag")).alias("label")
    )


@register
def decision_modes(spark, folder):
    df = items.decide_items(_replayed(spark, folder), RULES)
    return df.select("id", "mode", "rule_hint", "rules_notify")


@register
def classifier_worklist(spark, folder):
    # Stored before it is filtered, as in the item flow: see the note in operators/items.py.
    slim = _replayed(spark, folder).select(
        "id", "circuit", "source", "title", "text", "score", "intent_tag"
    )
    work = verdicts.work_list(items.decide_items(cut_lineage(slim), RULES)).drop("rule_hint")
    return work.withColumn("item_text", F.md5("item_text"))


def _responses(spark, folder):
    """Raw classifier answers made of documents: fenced, bare and broken ones."""
    docs = corpus.table(spark, folder, "documents")
    n = F.col("doc_id")
    lead_type = F.when(n % 3 == 0, "hiring_intent").when(n % 3 == 1, "pain_point").otherwise("not_a_lead")
    body = F.concat(
        F.lit('{"is_lead": '),
        # Classifiers also answer with numbers for conditions and quote their numbers.
        F.when((n % 5 == 2) & (n % 2 == 0), "1")
        .when(n % 5 == 2, "0")
        .when(n % 2 == 0, "true")
        .otherwise("false"),
        F.lit(', "confidence": '),
        F.format_string(
            "%s0.%02d%s", F.when(n % 3 == 1, '"').otherwise(""), (n % 100).cast("int"),
            F.when(n % 3 == 1, '"').otherwise(""),
        ),
        F.lit(', "lead_type": "'),
        lead_type,
        F.lit('", "summary_ru": "s'),
        n.cast("string"),
        F.lit('", "red_flags_ru": ["a", "b"]}'),
    )
    response = (
        F.when(n % 7 == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 7 == 4, F.concat(F.lit("  ```"), body, F.lit("```\n")))
        .when(n % 7 == 5, F.concat(F.lit("Sorry, "), F.col("source")))
        .otherwise(body)
    )
    return docs.select(n.alias("id"), "lang", "source", response.alias("response"))


@register
def verdict_parse(spark, folder):
    parsed = verdicts.parse_responses(_responses(spark, folder))
    return parsed.select(
        "id", "outcome", "verdict.is_lead", "verdict.confidence", "verdict.lead_type",
        "verdict.summary_ru", F.array_join("verdict.red_flags_ru", "|").alias("flags"),
    )


@register
def verdict_apply(spark, folder):
    n = F.col("raw_item_id")
    decided = corpus.matches(spark, folder).select(
        "id", "score", "intent_tag", "created_at",
        F.when(n % 4 == 0, decisions.TRANSLATE).when(n % 4 != 3, decisions.CLASSIFY).alias("mode"),
        (F.col("score") >= fixed.NOTIFY_THRESHOLD).alias("rules_notify"),
    )
    # No answer yet for one language, quota used up for one source.
    rows = verdicts.parse_responses(_responses(spark, folder))
    rows = rows.withColumn(
        "outcome",
        F.when(F.col("lang") == "fr", None)
        .when(F.col("source") == "src3", "quota_exhausted")
        .otherwise(F.col("outcome")),
    )
    final = verdicts.route_items(verdicts.apply_verdicts(decided, rows), at="created_at")
    return final.select(
        "id", "decided_by", "llm_status", "intent_tag", "llm_summary_ru", "llm_prob",
        "will_notify", "status", "queue",
    )


@register
def quiet_route(spark, folder):
    events = corpus.table(spark, folder, "events")
    score = F.floor("value").cast("int")
    quiet = decisions.in_quiet_hours(F.col("ts"))
    status = decisions.route_status(score, F.col("event_type") != "error", quiet)
    return events.select(
        "event_id", quiet.alias("quiet"), status.alias("status"),
        decisions.route_queue(status).alias("queue"),
    )


# --- sources and items ---------------------------------------------------------------------


@register
def source_gate(spark, folder):
    gated = items.source_gate(_feed(spark, folder), corpus.sources(spark, folder), at(NOW))
    return gated.select("id", "source", "circuit", "category", "priority")


@register
def active_sources(spark, folder):
    seeds = rule_tables.seed_sources(spark)
    sources = corpus.sources(spark, folder)
    return reports.active_sources(sources, "browse", seeds).withColumn("circuit", F.lit("browse")).unionByName(
        reports.active_sources(sources, "main", seeds).withColumn("circuit", F.lit("main"))
    )


@register
def active_sources_fallback(spark, folder):
    """No source of the table is enabled, so the seed list is used."""
    off = corpus.sources(spark, folder).withColumn("enabled", F.lit(False))
    return reports.active_sources(off, "main", rule_tables.seed_sources(spark))


@register
def sources_listing(spark, folder):
    return reports.sources_listing(corpus.sources(spark, folder), at(NOW))


@register
def stale_filter(spark, folder):
    n = F.col("id")
    feed = _feed(spark, folder).withColumn(
        "posted_at",
        F.when(n % 9 == 4, "no time").when(n % 9 != 5, F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")),
    )
    return items.drop_stale(feed, at("2024-01-01 12:00:00")).select("id")


@register
def first_seen(spark, folder):
    events = corpus.table(spark, folder, "events").select(
        F.concat(F.lit("item"), F.col("user_id").cast("string")).alias("item_id"),
        "ts",
        F.col("event_id").alias("id"),
    )
    return admin.first_seen(events, days=1)


@register
def cycle_counts(spark, folder):
    feed = _feed(spark, folder)
    stale = items.is_stale(F.col("posted_at"), at("2024-01-01 12:00:00"))
    return reports.cycle_counts(feed, stale, F.col("id") % 6 == 5)


@register
def feed_profile(spark, folder):
    return reports.feed_profile(_feed(spark, folder))


@register
def message_parse(spark, folder):
    """Documents as JSON messages, some of them broken, parsed back."""
    return messages.parse_messages(_messages(spark, folder)).select(
        "problem", "item_id", "source", "title", F.md5("body").alias("body"), "has_body", "tag",
        "posted_at", F.length("raw").isNotNull().alias("kept"),
    )


def _messages(spark, folder):
    n = F.col("id")
    feed = _feed(spark, folder).select(
        "id",
        "item_id",
        F.when(n % 17 != 3, F.col("source")).alias("source"),
        F.when(n % 19 != 4, F.col("title")).alias("title"),
        "body",
        "has_body",
        "author_handle",
        "permalink",
        F.when(n % 23 == 5, "soon").otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")).alias(
            "posted_at"
        ),
    )
    whole = F.to_json(F.struct(*[c for c in feed.columns if c != "id"]))
    value = F.when(n % 29 == 6, F.concat(F.lit("{broken "), whole)).otherwise(whole)
    return feed.select(value.alias("value"))


def _xml(value: Column) -> Column:
    for plain_text, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(plain_text), F.lit(entity))
    return value


@register
def atom_entries(spark, folder):
    """Documents written as feed entries and read back by the feed reader."""
    feed = _feed(spark, folder)
    n = F.col("id")
    content = F.when(
        F.col("has_body"),
        F.concat(F.lit("<!-- SC_OFF --><p>"), _xml(_xml(F.col("body"))), F.lit("</p><!-- SC_ON -->tail")),
    ).otherwise("no body here")
    entry = F.concat(
        F.lit("<entry>"),
        F.when(n % 31 != 7, F.concat(F.lit("<id>"), F.col("item_id"), F.lit("</id>"))).otherwise(""),
        F.lit('<category term="'), F.col("source"), F.lit('"/><author><name>/u/'), F.col("author_handle"),
        F.lit('</name></author><link href="'), F.col("permalink"), F.lit('"/><published>'),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</published><title>"),
        _xml(_xml(F.col("title"))), F.lit('</title><content type="html">'), _xml(content),
        F.lit("</content></entry>"),
    )
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    # Feed documents of a hundred entries, one per file, as a poll returns them.
    page = F.floor(n / 100).alias("page")
    document = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'),
        F.array_join(F.collect_list(entry), "\n"),
        F.lit("</feed>"),
    )
    pages = feed.groupBy(page).agg(document.alias("value")).select("value")
    pages.write.option("maxRecordsPerFile", 1).text(path)
    return atom.read_atom(spark, path).select(
        "item_id", "source", F.md5("title").alias("title"), F.md5("body").alias("body"), "has_body",
        "tag", "author_handle", "permalink", "posted_at",
    )


# --- authors, feedback, reports ------------------------------------------------------------


def _tables(spark, folder):
    return (
        corpus.raw_items(spark, folder),
        corpus.matches(spark, folder),
        corpus.feedback(spark, folder),
    )


@register
def author_counters(spark, folder):
    raw, matches, votes = _tables(spark, folder)
    return reports.author_counters(votes, matches, raw)


@register
def author_bonus(spark, folder):
    raw, matches, votes = _tables(spark, folder)
    counters = reports.author_counters(votes, matches, raw)
    return items.with_author_bonus(raw.select("id", "author_handle"), counters, RULES)


@register
def period_stats(spark, folder):
    return reports.period_stats(*_tables(spark, folder), at(SINCE))


@register
def weekly_report(spark, folder):
    raw, matches, votes = _tables(spark, folder)
    usage = corpus.usage_log(spark, folder)
    used = quota.quota_usage(_calls(spark, folder), at("2024-01-10 12:00:00"), per_minute=1)
    return reports.weekly_report(raw, matches, votes, usage, at(SINCE), used)


@register
def weekly_top_bad(spark, folder):
    raw, matches, votes = _tables(spark, folder)
    return reports.bad_by_source(votes, matches, raw, at(SINCE))


@register
def calls_by_outcome(spark, folder):
    return reports.outcome_counts(corpus.usage_log(spark, folder), at("2024-01-10 00:00:00"))


@register
def circuit_outcomes(spark, folder):
    return reports.circuit_outcomes(corpus.usage_log(spark, folder))


def _calls(spark, folder):
    return corpus.usage_log(spark, folder).select("id", "circuit", F.col("created_at").alias("ts"))


@register
def quota_admission(spark, folder):
    return quota.admit_calls(_calls(spark, folder), per_minute=1, per_day=50)


@register
def quota_usage(spark, folder):
    return quota.quota_usage(_calls(spark, folder), at("2024-01-10 12:00:00"), per_minute=1)


@register
def rate_cap(spark, folder):
    return reports.send_rate(corpus.table(spark, folder, "events"), limit=2, seconds=600)


@register
def send_times(spark, folder):
    """When each event would go out if three may go out in ten minutes."""
    requests = corpus.table(spark, folder, "events").select(F.col("event_id").alias("id"), "ts")
    return reports.send_times(requests, limit=3, seconds=600)


@register
def heartbeat_gaps(spark, folder):
    return reports.heartbeat_gaps(corpus.heartbeats(spark, folder))


@register
def silent_circuits(spark, folder):
    beats = corpus.heartbeats(spark, folder)
    monitored = beats.select("circuit").distinct()
    seen = beats.withColumn("ts", F.when(F.col("value") > 100, F.col("ts")))
    return reports.silent_circuits(monitored, seen, at("2024-01-30 00:00:00"))


@register
def digest_top(spark, folder):
    raw, matches, _ = _tables(spark, folder)
    return reports.digest(matches, raw)


@register
def card_view(spark, folder):
    raw, matches, _ = _tables(spark, folder)
    n = F.col("id")
    names = ["spark", "python", "etl", "sql", "dbt", "kafka", "flink", "hive", "trino"]
    verdict = F.struct(
        F.when(n % 4 == 1, F.concat(F.lit("need "), n.cast("string"))).otherwise("").alias("need_ru"),
        F.when(n % 5 == 2, F.concat(F.lit("about "), n.cast("string"))).otherwise("").alias("budget_hint"),
        F.slice(F.array(F.lit("late"), F.lit("cheap")), F.lit(1), (n % 3).cast("int")).alias("red_flags_ru"),
    )
    stack = F.slice(F.array(*map(F.lit, names)), F.lit(1), (n % 10).cast("int"))
    return reports.cards(matches.withColumns({"llm_verdict": verdict, "stack_matched": stack}), raw)


@register
def retention(spark, folder):
    raw, _, _ = _tables(spark, folder)
    return reports.retained(raw, at("2024-01-31 08:00:00")).select("id", "reject_rule")


# --- lead funnel ---------------------------------------------------------------------------


def _crm(spark, folder):
    outcomes = crm.command_outcomes(
        corpus.crm_commands(spark, folder), corpus.matches(spark, folder)
    )
    # Stored like the CRM table it stands for: the lead queries below read it more than once.
    return cut_lineage(crm.crm_state(outcomes))


def _slim_leads(spark, folder):
    raw, matches, _ = _tables(spark, folder)
    return raw, crm.slim_leads(matches, _crm(spark, folder))


@register
def crm_outcomes(spark, folder):
    outcomes = crm.command_outcomes(
        corpus.crm_commands(spark, folder), corpus.matches(spark, folder)
    )
    return outcomes.select("cmd_id", "match_id", "kind", "outcome")


@register
def crm_state(spark, folder):
    outcomes = crm.command_outcomes(
        corpus.crm_commands(spark, folder), corpus.matches(spark, folder)
    )
    return crm.crm_state(outcomes)


@register
def crm_violations(spark, folder):
    """Commands read as if they were CRM rows, so that every rule has rows that break it."""
    rows = corpus.crm_commands(spark, folder).select(
        F.col("cmd_id").alias("match_id"),
        F.coalesce("contact_state", F.lit("done")).alias("contact_state"),
        F.col("earnings").cast("decimal(12,2)").alias("earnings"),
        "currency",
        (F.col("taken_in_work") == "true").alias("taken_in_work"),
        F.when(F.col("cmd_id") % 2 == 0, F.col("ts")).alias("contacted_at"),
        F.when(F.col("cmd_id") % 3 == 0, F.col("ts")).alias("in_work_at"),
    )
    return crm.crm_violations(rows)


@register
def funnel_stats(spark, folder):
    return crm.funnel_stats(corpus.matches(spark, folder), _crm(spark, folder))


@register
def earnings_by_currency(spark, folder):
    return crm.earnings_by_currency(_crm(spark, folder))


@register
def lead_filters(spark, folder):
    """Leads of every funnel slice."""
    _, matches, _ = _tables(spark, folder)
    return crm.lead_slices(matches, _crm(spark, folder))


@register
def lead_page(spark, folder):
    raw, slim = _slim_leads(spark, folder)
    return crm.with_source(crm.lead_page(slim, limit=30, offset=30), raw)


@register
def lead_page_after(spark, folder):
    raw, slim = _slim_leads(spark, folder)
    return crm.with_source(crm.lead_page_after(slim, "2024-01-01 02:00:00", 121, 20), raw)


@register
def lead_detail(spark, folder):
    raw, matches, _ = _tables(spark, folder)
    details = crm.lead_details(matches, raw, _crm(spark, folder))
    return details.select(
        "id", "score", "circuit", "raw_item.url", "raw_item.title", "raw_item.posted_at",
        F.md5("raw_item.text").alias("text"), "crm.contact_state", "crm.response_text",
        "crm.taken_in_work", "crm.earnings", "crm.contacted_at",
    )


@register
def deeplink_page(spark, folder):
    raw, slim = _slim_leads(spark, folder)
    return crm.with_source(crm.page_with_pinned(slim, 3), raw)


@register
def missing_leads(spark, folder):
    _, matches, votes = _tables(spark, folder)
    return crm.missing_leads(votes.select("match_id"), matches, _crm(spark, folder))


@register
def favorites(spark, folder):
    return crm.favorites(corpus.matches(spark, folder))


# --- change logs ---------------------------------------------------------------------------


@register
def latest_keywords(spark, folder):
    return admin.keyword_state(corpus.keyword_log(spark, folder)).drop("maps_to")


@register
def keywords_after_log(spark, folder):
    """Disabling commands applied to a table of all terms of the enabling ones."""
    log = corpus.keyword_log(spark, folder)
    table = (
        log.filter("action = 'add' AND dict_type <> 'slang'")
        .groupBy("dict_type", F.lower("term").alias("term"))
        .agg(F.lit(7).alias("weight"), F.lit(None).cast("string").alias("maps_to"))
        .withColumn("enabled", F.lit(True))
    )
    return admin.keyword_state(log.filter("action = 'del'"), table)


@register
def seeded_rules(spark, folder):
    """Seed keywords and weights put in beside what the change logs leave; edited rows stay."""
    keywords = admin.keyword_state(corpus.keyword_log(spark, folder)).drop("maps_to")
    key = ["dict_type", "term"]
    filled = admin.insert_if_absent(keywords, rule_tables.seed_keywords(spark).drop("maps_to"), key, key)
    log = corpus.numbered_events(spark, folder).select(
        F.col("event_id").alias("id"), "ts", F.col("k").alias("weight"),
        F.when(F.col("user_id") % 2 == 0, "has_sections").otherwise("no_body").alias("key"),
    )
    edited = admin.weights_listing(admin.weight_state(log)).select("key", F.col("weight").cast("int").alias("weight"))
    weights = admin.insert_if_absent(edited, rule_tables.seed_rule_weights(spark), ["key"], ["key"])
    return filled.unionByName(
        weights.select(
            F.lit("weight").alias("dict_type"), F.col("key").alias("term"), "weight", F.lit(True).alias("enabled")
        )
    )


@register
def dictionary_listing(spark, folder):
    return rule_tables.dictionary_listing(admin.keyword_state(corpus.keyword_log(spark, folder)))


@register
def weight_state(spark, folder):
    log = corpus.numbered_events(spark, folder).select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(F.col("user_id") == 0, fixed.THRESHOLD_KEY)
        .otherwise(F.concat(F.lit("rule"), F.col("user_id").cast("string")))
        .alias("key"),
        F.col("k").alias("weight"),
    )
    return admin.weights_listing(admin.weight_state(log))


@register
def source_state(spark, folder):
    kind = F.col("event_type")
    k = F.col("k")
    log = corpus.numbered_events(spark, folder).select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(kind == "view", "mute").when(kind == "click", "unmute").otherwise("category").alias("action"),
        F.concat(F.lit("SRC"), (F.col("user_id") % 15).cast("string")).alias("name"),
        F.when(k % 4 != 0, k).alias("hours"),
        F.element_at(F.array(*map(F.lit, [*fixed.CATEGORIES, "gossip"])), (k % 9 + 1).cast("int")).alias(
            "category"
        ),
    )
    state = admin.source_state(corpus.sources(spark, folder), log)
    return state.select("name", "category", "muted_until", "priority")


@register
def source_stubs(spark, folder):
    known = corpus.sources(spark, folder).filter("priority > 0")
    return admin.source_stubs(_feed(spark, folder), known)


@register
def seed_if_absent(spark, folder):
    """Sources of the documents inserted into the seed sources and into themselves."""
    found = corpus.sources(spark, folder).select("name", "category", "circuit", "enabled", "priority")
    half = found.filter("priority > 1").withColumn("category", F.lit("kept"))
    return admin.insert_if_absent(half, found, ["name"], ["name"])


def _clicks(spark, folder):
    kind = F.col("event_type")
    reasons = [*fixed.FEEDBACK_REASONS, "because"]
    return corpus.table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("match_id"),
        F.when(kind == "purchase", "favorite").when(kind == "error", "not_this").otherwise("open").alias(
            "action"
        ),
        F.element_at(F.array(*map(F.lit, reasons)), (F.col("event_id") % 9 + 1).cast("int")).alias("reason"),
    )


@register
def feedback_events(spark, folder):
    return admin.feedback_events(_clicks(spark, folder))


@register
def favorite_matches(spark, folder):
    return admin.favorite_matches(_clicks(spark, folder))


@register
def match_status(spark, folder):
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "notified").when(kind == "error", "suppressed")
        .when(kind == "view", "digest_pending").otherwise("new")
    )
    events = corpus.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("match_id"), status.alias("status")
    )
    return admin.match_status(corpus.matches(spark, folder), events).select("id", "status", "notified_at")


# --- the whole way of an item --------------------------------------------------------------


@register
def item_flow(spark, folder):
    """Batch processing of all items: gate, duplicates, rules."""
    authors = author_counters(spark, folder)
    result = flow.process(
        _feed(spark, folder), corpus.sources(spark, folder), authors, RULES, at(NOW), token_hash="md5"
    )
    return result.raw_items.select("id", "source", "circuit", "reject_rule", "duplicate_of")


def _processed(spark, folder):
    """Batch processing with the classifier off, at a moment that is night in the reader's zone."""
    return flow.process(
        _feed(spark, folder), corpus.sources(spark, folder), author_counters(spark, folder), RULES,
        at(NOW), classifier_on=False, zone="America/Los_Angeles", token_hash="md5",
    )


@register
def item_flow_matches(spark, folder):
    """Matches that batch processing leaves, with the classifier off: rules route them."""
    matches = _processed(spark, folder).matches
    return matches.select("id", "score", "intent_tag", "status", "queue", "llm_status")


@register
def flow_cards(spark, folder):
    """Cards of the matches and items that batch processing stores."""
    result = _processed(spark, folder)
    return reports.cards(result.matches, result.raw_items).select(
        "id", "headline", "score", "intent_label", "source", "author_handle", "posted_local", "body",
        "is_original", "need", "flags", "more_like_this", "rules_only_note",
    )


@register
def flow_digest(spark, folder):
    """Digest of the matches and items that batch processing stores."""
    result = _processed(spark, folder)
    return reports.digest(cut_lineage(result.matches), result.raw_items)


@register
def flow_dry_run_stored(spark, folder):
    """The stored items replayed through the rules."""
    stored = cut_lineage(_processed(spark, folder).raw_items)
    replayed = items.dry_run(stored, corpus.sources(spark, folder), RULES)
    passed = F.col("reject_rule").isNull()
    return replayed.select("id", "reject_rule", F.when(passed, F.col("score")).alias("score"))


@register
def item_stream(spark, folder):
    """The same items as JSON messages through the streaming job, in several micro-batches."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    feed = _feed(spark, folder)
    message = F.to_json(
        F.struct(
            "item_id", "source", "title", "body", "has_body", "author_handle", "permalink",
            F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"),
        )
    )
    sources = corpus.sources(spark, folder)
    tables = ingest.Tables(
        rules=lambda: RULES,
        sources=lambda: sources,
        authors=lambda: spark.createDataFrame([], schemas.AUTHORS),
    )
    # Three deliveries in time order; each run takes up what has come in since the last one.
    ends = feed.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 3 + 1
    for part in range(3):
        start = ends["low"] + part * step
        delivery = feed.filter(F.col("id").between(start, start + step - 1))
        delivery.select(message.alias("value")).write.mode("append").text(f"{run}/in")
        ingest.run_messages(
            messages.read_message_stream(spark, f"{run}/in"),
            f"{run}/store", f"{run}/checkpoint", tables, now=at(NOW), token_hash="md5",
        ).awaitTermination()
    stored = ingest.read_raw_items(spark, f"{run}/store")
    original = stored.select(F.col("id").alias("duplicate_of"), F.col("item_id").alias("original"))
    return stored.join(original, "duplicate_of", "left").select(
        F.col("item_id").cast("bigint").alias("id"), "source", "circuit", "reject_rule",
        F.col("original").cast("bigint").alias("duplicate_of"),
    )


def _open_sources(spark, folder):
    """All sources, enabled and not muted, so that what is not stored was turned away at the edge."""
    return corpus.sources(spark, folder, all_enabled=True).withColumn(
        "muted_until", F.lit(None).cast("timestamp")
    )


def _message(posted: Column) -> Column:
    return F.to_json(
        F.struct(
            "item_id", "source", "title", "body", "has_body", "author_handle", "permalink",
            F.date_format(posted, "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"),
        )
    ).alias("value")


# Items that come again or late: (modulus, remainder, places later, prefix of the id, posted anew).
SENT_AGAIN = [(10, 3, 20, "", True), (10, 7, 120, "", True), (14, 5, 200, "late-", False)]


@register
def edge_stream(spark, folder):
    """What the edge of the streaming job does with items that come again or too late."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    feed = _feed(spark, folder)
    n = F.col("id")
    sendings = feed.withColumn("place", n)
    for modulus, remainder, later, prefix, anew in SENT_AGAIN:
        again = feed.filter(n % modulus == remainder).withColumns(
            {
                "item_id": F.concat(F.lit(prefix), "item_id"),
                "place": n + later,
                "posted_at": corpus.minutes_after_start((n + later * int(anew)) * corpus.MINUTES_BETWEEN_ITEMS),
            }
        )
        sendings = sendings.unionByName(again)
    sendings = cut_lineage(sendings.select("place", _message(F.col("posted_at"))))
    sources = _open_sources(spark, folder)
    tables = ingest.Tables(
        rules=lambda: RULES, sources=lambda: sources, authors=lambda: spark.createDataFrame([], schemas.AUTHORS)
    )
    ends = feed.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 3 + 1
    for part in range(3):
        start = ends["low"] + part * step
        delivery = sendings.filter(F.col("place").between(start, start + step - 1))
        delivery.select("value").write.mode("append").text(f"{run}/in")
        ingest.run_messages(
            messages.read_message_stream(spark, f"{run}/in"), f"{run}/store", f"{run}/checkpoint", tables,
            edge=ingest.Edge(), now=at(NOW), token_hash="md5",
        ).awaitTermination()
    stored = ingest.read_raw_items(spark, f"{run}/store")
    outcomes = [stored.select("item_id", "posted_at", F.lit("stored").alias("outcome"))]
    for name in ("late", "repeated"):
        table = sinks.read_table(spark, f"{run}/store/{name}", ingest.TURNED_AWAY)
        outcomes.append(table.select("item_id", "posted_at", F.lit(name).alias("outcome")))
    return functools.reduce(DataFrame.unionByName, outcomes)


# --- rule tables, exports and running counts ------------------------------------------------


@register
def loaded_rules_summary(spark, folder):
    """The dry run under rules that come from keyword and weight tables."""
    rows = [(kind, term, weight, target, True) for kind, term, weight, target in corpus.KEYWORD_ROWS]
    off = ("stack_core", "the", 9, None, False)
    keywords = spark.createDataFrame([*rows, off], schemas.KEYWORDS)
    weights = spark.createDataFrame(list(fixed.RULE_WEIGHTS.items()), schemas.RULE_WEIGHTS)
    rules = rule_tables.load_rules(keywords, weights, help_pattern=corpus.HELP_WORDS)
    replayed = items.dry_run(_feed(spark, folder), corpus.sources(spark, folder), rules)
    return items.dry_run_summary(replayed, rules)


@register
def usage_rows(spark, folder):
    """Usage-log rows of the calls, with the default model where none is named."""
    n = F.col("id")
    calls = corpus.usage_log(spark, folder).withColumns(
        {
            "mode": F.when(n % 3 == 0, decisions.TRANSLATE).otherwise(decisions.CLASSIFY),
            "circuit": F.when(n % 5 != 4, F.col("circuit")),
            "model": F.when(n % 4 == 1, "model-b"),
            "prompt_tokens": n * 3,
            "output_tokens": n % 100,
            "error": F.when(F.col("outcome") == "error", "broken"),
        }
    )
    return sinks.usage_rows(calls, "model-a")


@register
def json_export(spark, folder):
    raw, _, _ = _tables(spark, folder)
    return sinks.as_json(raw.select("id", "source", "author_handle", "reject_rule"))


def _streamed(spark, folder, name, job):
    """What a stream over a test table has counted after it has read all of it."""
    run = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A glob, since a stream reads folders or patterns and the table may be one file.
    source = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/table")

    query = (
        job(source).writeStream.foreachBatch(store).outputMode("complete")
        .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{run}/table")


def _event_stream(source):
    n = F.col("user_id")
    return source.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(n % 2 == 0, "main").otherwise("browse").alias("side"),
        F.concat(F.lit("c"), n.cast("string")).alias("circuit"),
    )


@register
def call_minutes_stream(spark, folder):
    """Calls per circuit and minute, counted by a stream."""
    def job(source):
        return ingest.call_windows(_event_stream(source).select("ts", F.col("side").alias("circuit")))

    return _streamed(spark, folder, "events", job)


@register
def last_beats_stream(spark, folder):
    """The last heartbeat of each circuit, kept by a stream."""
    return _streamed(spark, folder, "events", lambda s: ingest.last_beats(_event_stream(s)))


# --- streams with state per key -------------------------------------------------------------


def _delivered(spark, rows, job, order="id", parts=3):
    """What a keyed stream emits for ``rows``, which come in several deliveries in their order.

    Each delivery is a run of its own that takes up the state of the last one.
    """
    run = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    stored = cut_lineage(rows)
    ends = stored.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    step = (ends["high"] - ends["low"]) // parts + 1
    for part in range(parts):
        start = ends["low"] + part * step
        delivery = stored.filter(F.col(order).between(start, start + step - 1))
        delivery.write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(stored.schema).parquet(f"{run}/in")
        keyed.run_keyed(job(stream), f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/out").drop("batch_id")


@register
def exact_dups_stream(spark, folder):
    """Exact originals found by a stream that keeps the texts of thirty days as keyed state."""
    hashed = _norm(spark, folder).select("id", "ts", hashing.text_hash(F.col("text_norm")).alias("text_hash"))
    return _delivered(spark, hashed, keyed.exact_originals_stream)


@register
def quota_admission_stream(spark, folder):
    """Admission of calls by counters that a stream keeps across its micro-batches."""
    return _delivered(
        spark, _calls(spark, folder), lambda calls: keyed.admit_calls_stream(calls, per_minute=1, per_day=50)
    )


@register
def silence_alerts_stream(spark, folder):
    """Silences that a stream reports, those that still last at its end too."""
    alerts = _delivered(spark, corpus.heartbeats(spark, folder).select("circuit", "ts", "id"), keyed.silence_alerts)
    return alerts.select("circuit", "silent_from")


# --- jobs over the store --------------------------------------------------------------------


def _store(spark):
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@register
def digest_runs(spark, folder):
    """Three digests in a row: each shows the first that wait, and none shows a match again."""
    raw, matches, _ = _tables(spark, folder)
    store = _store(spark)
    runs = [
        jobs.send_digest(matches, raw, store, run, at(f"{day} 09:00:00")).withColumn("run", F.lit(run))
        for run, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-31"])
    ]
    return functools.reduce(DataFrame.unionByName, runs).drop("sent_at")


@register
def paused_sending(spark, folder):
    """What four runs of the sender send; the second falls into a pause."""
    matches = corpus.matches(spark, folder)
    store = _store(spark)
    settings = spark.createDataFrame([("paused", "1")], "key string, value string")
    runs = []
    for run, moment in enumerate(["01-01 01:00:00", "01-01 02:00:00", "01-01 03:00:00", "01-31 00:00:00"]):
        paused = settings if run == 1 else settings.filter("false")
        sent = jobs.send_waiting(matches, store, run, at(f"2024-{moment}"), paused)
        runs.append(sent.select("match_id", F.lit(run).alias("run"), "sent_at"))
    return functools.reduce(DataFrame.unionByName, runs)


@register
def card_updates_stream(spark, folder):
    """Duplicate counts of cards as a stream of duplicates leaves them, in three deliveries."""
    store = _store(spark)
    found = cut_lineage(dedup.originals(_keys(spark, folder)))
    matches = corpus.matches(spark, folder)
    for part in range(3):
        sinks.write_batch(found.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part), f"{store}/duplicates", part)
        arrived = spark.readStream.schema(f"{ingest.DUPLICATES_TABLE}, batch_id BIGINT").parquet(f"{store}/duplicates")
        jobs.card_updates(arrived, lambda: matches, store, f"{store}/checkpoint").awaitTermination()
    return jobs.current_counts(spark, store)


@register
def flow_verdicts(spark, folder):
    """Stored matches after three passes of the classifier: one half answered, one short of quota, one idle."""
    result = flow.process(
        _feed(spark, folder), corpus.sources(spark, folder), author_counters(spark, folder), RULES, at(NOW),
        token_hash="md5",
    )
    store = _store(spark)
    sinks.write_matches(result.matches, f"{store}/matches", 0)
    sinks.write_batch(result.work, f"{store}/work", 0)
    answers = _responses(spark, folder).select("id", "response")
    some = answers.filter("id % 3 <> 0")
    left = spark.createDataFrame([("main", 20), ("browse", 5)], "circuit string, calls int")
    moment = at("2024-01-02 23:30:00")
    for run, (known, quota_left) in enumerate([(some, None), (answers, left), (answers, None)]):
        jobs.judge(
            spark, store, run, lambda work, known=known: known.join(work.select("id"), "id", "left_semi"),
            RULES, moment, quota_left, model="model-a",
        )
    passes = sinks.read_table(spark, f"{store}/usage", "match_id BIGINT").groupBy("match_id").agg(
        F.max("batch_id").alias("pass"), F.count("*").alias("calls")
    )
    final = jobs.read_matches(spark, store)
    return final.join(passes, F.col("id") == F.col("match_id"), "left").select(
        "id", "score", "decided_by", "llm_status", "intent_tag", "llm_summary_ru", "llm_prob", "status", "queue",
        "pass", "calls",
    )


@register
def retention_store(spark, folder):
    """Items of the store after two compactions with retention, a batch later than the first one between."""
    raw, _, _ = _tables(spark, folder)
    store = _store(spark)
    own = F.when(F.col("reject_rule") != "duplicate", F.col("reject_rule"))
    third = F.pmod(F.floor(F.col("id") / 7), F.lit(3))
    duplicates = raw.filter("reject_rule = 'duplicate'").select("id", F.lit(0).cast("bigint").alias("duplicate_of"))
    sinks.write_batch(duplicates, f"{store}/duplicates", 0)
    rows = raw.withColumns({"reject_rule": own, "ts": F.col("created_at")})
    versions = []
    for batch in range(3):
        sinks.write_raw_items(rows.filter(third == batch), f"{store}/raw_items", batch)
        if batch:
            moment = at(f"2024-01-31 0{2 * batch}:00:00")
            jobs.compact(spark, store, batch - 1 if batch == 1 else batch, moment)
            kept = cut_lineage(ingest.read_raw_items(spark, store).select("id", "reject_rule"))
            versions.append(kept.withColumn("version", F.lit(batch)))
    return functools.reduce(DataFrame.unionByName, versions)


@register
def reloaded_rules_stream(spark, folder):
    """Reject rules of streamed items; before the last delivery two dictionaries are emptied."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keywords = spark.createDataFrame([(*row, True) for row in corpus.KEYWORD_ROWS], schemas.KEYWORDS)
    weights = spark.createDataFrame(list(fixed.RULE_WEIGHTS.items()), schemas.RULE_WEIGHTS)
    edited = keywords.withColumn("enabled", ~F.col("dict_type").isin("anti", "closed"))
    sources = corpus.sources(spark, folder)
    feed = cut_lineage(_feed(spark, folder))
    tables = ingest.Tables(
        rules=rule_tables.RuleReader(spark, f"{run}/rules", help_pattern=corpus.HELP_WORDS),
        sources=lambda: sources,
        authors=lambda: spark.createDataFrame([], schemas.AUTHORS),
    )
    for part, words in enumerate([keywords, edited]):
        rule_tables.publish_rules(spark, f"{run}/rules", words, weights)
        delivery = feed.filter(F.col("id") % 2 == part).withColumn("posted_at", F.col("ts"))
        delivery.write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(delivery.schema).parquet(f"{run}/in").drop("id", "ts", "created_at")
        ingest.run_items(
            stream, f"{run}/store", f"{run}/checkpoint", tables, now=at(NOW), token_hash="md5"
        ).awaitTermination()
    stored = sinks.read_table(spark, f"{run}/store/raw_items", ingest.RAW_TABLE)
    return stored.select(F.col("item_id").cast("bigint").alias("id"), "circuit", "reject_rule")
