"""Reports, liveness and delivery views over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions import decisions
from gleaner.operators.crm import with_total
from gleaner.operators.ordered import carry_last, numbered, time_chunk
from gleaner.session import broadcast_if_small


def _ratio() -> Column:
    return decisions.precision(F.col("good"), F.col("bad")).alias("precision")


def period_stats(
    raw_items: DataFrame, matches: DataFrame, feedback: DataFrame, since: Column
) -> DataFrame:
    """seen, matched, notified, good, bad and precision from ``since`` on, in one row."""
    recent = F.col("created_at") >= since
    seen = raw_items.filter(recent).agg(F.count("*").alias("n"))
    matched = matches.filter(recent).agg(
        F.struct(
            F.count("*").alias("matched"), F.count_if(F.col("status") == "notified").alias("notified")
        )
    )
    votes = feedback.filter(recent).agg(
        F.struct(
            F.count_if(F.col("verdict") == "good").alias("good"),
            F.count_if(F.col("verdict") == "bad").alias("bad"),
        )
    )
    one = raw_items.sparkSession.range(1)
    return one.select(
        seen.scalar().alias("seen"), matched.scalar().alias("m"), votes.scalar().alias("v")
    ).select("seen", "m.*", "v.*").select("*", _ratio())


def outcome_counts(usage: DataFrame, since: Column | None = None) -> DataFrame:
    recent = usage if since is None else usage.filter(F.col("created_at") >= since)
    return recent.groupBy("outcome").agg(F.count("*").alias("calls"))


def circuit_outcomes(usage: DataFrame) -> DataFrame:
    return usage.groupBy("circuit", "outcome").agg(F.count("*").alias("calls"))


def bad_by_source(
    feedback: DataFrame, matches: DataFrame, raw_items: DataFrame, since: Column, n: int = 5
) -> DataFrame:
    """Sources with the most bad feedback."""
    bad = feedback.filter((F.col("created_at") >= since) & (F.col("verdict") == "bad"))
    return (
        bad.join(
            matches.select(F.col("id").alias("match_id"), "raw_item_id"), "match_id"
        )
        .join(raw_items.select(F.col("id").alias("raw_item_id"), "source"), "raw_item_id")
        .groupBy("source")
        .agg(F.count("*").alias("bad"))
        .orderBy(F.desc("bad"), "source")
        .limit(n)
    )


def weekly_report(
    raw_items: DataFrame,
    matches: DataFrame,
    feedback: DataFrame,
    usage: DataFrame,
    since: Column,
    quota_now: DataFrame | None = None,
) -> DataFrame:
    """(section, name, value): notified, feedback, precision, calls by outcome, worst sources, quota.

    ``quota_now`` is the state of the call quotas as ``quota.quota_usage`` gives it.
    """

    def section(df: DataFrame, title: str, name: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(title).alias("section"), name.alias("name"), value.cast("double").alias("value")
        )

    sent = matches.filter(F.col("notified_at") >= since).agg(F.count("*").alias("n"))
    votes = feedback.filter(F.col("created_at") >= since).agg(
        F.count_if(F.col("verdict") == "good").alias("good"),
        F.count_if(F.col("verdict") == "bad").alias("bad"),
    )
    # One pass over feedback, turned into three rows.
    turned = votes.select(
        F.explode(
            F.array(
                F.struct(F.lit("feedback").alias("s"), F.lit("good").alias("k"), F.col("good").cast("double").alias("v")),
                F.struct(F.lit("feedback").alias("s"), F.lit("bad").alias("k"), F.col("bad").cast("double").alias("v")),
                F.struct(F.lit("precision").alias("s"), F.lit("all").alias("k"), decisions.precision(F.col("good"), F.col("bad")).alias("v")),
            )
        ).alias("row")
    ).select(F.col("row.s").alias("section"), F.col("row.k").alias("name"), F.col("row.v").alias("value"))
    report = (
        section(sent, "notified", F.lit("all"), F.col("n"))
        .unionByName(turned)
        .unionByName(section(outcome_counts(usage, since), "calls", F.col("outcome"), F.col("calls")))
        .unionByName(
            section(
                bad_by_source(feedback, matches, raw_items, since),
                "bad_by_source",
                F.col("source"),
                F.col("bad"),
            )
        )
    )
    if quota_now is None:
        return report
    for used in ("day_used", "min_used"):
        name = F.concat_ws(" ", "circuit", F.lit(used))
        report = report.unionByName(section(quota_now, "quota", name, F.col(used)))
    return report


def author_counters(feedback: DataFrame, matches: DataFrame, raw_items: DataFrame) -> DataFrame:
    """(handle, good_count, bad_count) rebuilt from all feedback."""
    handles = matches.select(F.col("id").alias("match_id"), "raw_item_id").join(
        raw_items.select(F.col("id").alias("raw_item_id"), F.col("author_handle").alias("handle")),
        "raw_item_id",
    )
    return (
        feedback.join(handles, "match_id")
        .filter(F.coalesce(F.length("handle"), F.lit(0)) > 0)
        .groupBy("handle")
        .agg(
            F.count_if(F.col("verdict") == "good").alias("good_count"),
            F.count_if(F.col("verdict") == "bad").alias("bad_count"),
        )
    )


def feed_profile(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("entries"),
        F.count_if("has_body").alias("with_body"),
        F.count_if(~F.col("has_body")).alias("link_only"),
        F.count_distinct("source").alias("sources"),
    )


def cycle_counts(items: DataFrame, stale: Column, seen_before: Column) -> DataFrame:
    """entries, published and skipped_old of one collection cycle."""
    return items.agg(
        F.count("*").alias("entries"),
        F.count_if(~stale & ~seen_before).alias("published"),
        F.count_if(stale).alias("skipped_old"),
    )


def heartbeat_gaps(
    beats: DataFrame, seconds: int = fixed.SILENCE_SECONDS, chunk_seconds: int = 3600
) -> DataFrame:
    """(circuit, silent_from, silent_to, gap_seconds): silences longer than ``seconds``."""
    linked = carry_last(
        beats.select("circuit", "ts", "id"),
        ["circuit"],
        "ts",
        "id",
        {"silent_from": F.col("ts")},
        chunk_seconds,
    )
    gap = (F.unix_micros("ts") - F.unix_micros("silent_from")) / 1_000_000
    return linked.select(
        "circuit", "silent_from", F.col("ts").alias("silent_to"), gap.alias("gap_seconds")
    ).filter(F.col("gap_seconds") > seconds)


def silent_circuits(
    monitored: DataFrame, beats: DataFrame, now: Column, seconds: int = fixed.SILENCE_SECONDS
) -> DataFrame:
    """Monitored circuits without a heartbeat in the last ``seconds``, or without any."""
    last = beats.groupBy("circuit").agg(F.max("ts").alias("last_beat"))
    silence = F.unix_timestamp(now) - F.unix_timestamp("last_beat")
    return (
        monitored.join(last, "circuit", "left")
        .withColumn("silent_seconds", silence)
        .filter(F.col("last_beat").isNull() | (F.col("silent_seconds") > seconds))
    )


def send_rate(
    sends: DataFrame, limit: int = fixed.SENDS_PER_MINUTE, seconds: int = 60
) -> DataFrame:
    """(ts, sent, in_window, over_cap) per send time: sends in the last ``seconds`` seconds.

    Equal times collapse first.  Each time is then counted into its own time chunk and the
    next, so that a chunk holds all it needs and no window spans the table.
    """
    per_time = sends.groupBy("ts").agg(F.count("*").alias("sent"))
    chunk = time_chunk(F.col("ts"), seconds)
    spread = per_time.select(
        "ts",
        "sent",
        F.unix_micros("ts").alias("_at"),
        chunk.alias("_own"),
        F.explode(F.array(chunk, chunk + 1)).alias("_chunk"),
    )
    window = Window.partitionBy("_chunk").orderBy("_at")
    # Running totals instead of a sliding frame: the frame would be summed anew for each row.
    upto = F.sum("sent").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = spread.withColumn("_upto", upto)
    events = totals.select("*", F.lit(0).alias("_ask")).unionByName(
        totals.filter("_own = _chunk").select(
            "ts", "sent", (F.col("_at") - seconds * 1_000_000).alias("_at"), "_own", "_chunk",
            F.col("_upto").alias("_upto"), F.lit(1).alias("_ask"),
        )
    )
    # Total just before the window begins: the last one at an earlier time.
    before = F.last(F.when(F.col("_ask") == 0, F.col("_upto")), ignorenulls=True).over(
        Window.partitionBy("_chunk")
        .orderBy("_at", F.desc("_ask"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = events.withColumn("_before", F.coalesce(before, F.lit(0))).filter("_ask = 1")
    in_window = F.col("_upto") - F.col("_before")
    return counted.select(
        "ts", "sent", in_window.alias("in_window"), (in_window > limit).alias("over_cap")
    )


def send_times(
    requests: DataFrame, limit: int = fixed.SENDS_PER_MINUTE, seconds: int = 60
) -> DataFrame:
    """(id, ts, sent_at): the earliest send time of each request (id, ts) under the cap.

    Requests are sent in the order (ts, id), at most ``limit`` in any ``seconds`` seconds: the n-th
    goes out at its own time, or ``seconds`` after the one ``limit`` places before it if that is
    later.  With n = limit * j + r, the send time less j * ``seconds`` is a running maximum of the
    request times less j * ``seconds`` within the lane r.  Rows are laid out in ranges of the order,
    the maximum runs within each range, and one row per range and lane carries it over, so no task
    holds the log.  Requests without a time are not sent.
    """
    queue = numbered(requests.filter("ts IS NOT NULL").select("id", "ts"), ["ts", "id"], "_n")
    step = F.floor(F.col("_n") / limit) * (seconds * 1_000_000)
    laned = queue.withColumns(
        {"_lane": F.col("_n") % limit, "_shift": step, "_own": F.unix_micros("ts") - step}
    )
    in_range = Window.partitionBy("_range", "_lane").orderBy("_n")
    earlier = Window.partitionBy("_l").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    tops = laned.groupBy(F.col("_range").alias("_r"), F.col("_lane").alias("_l")).agg(
        F.max("_own").alias("_top")
    )
    carried = tops.select("_r", "_l", F.max("_top").over(earlier).alias("_carried"))
    local = laned.withColumn("_best", F.max("_own").over(in_range))
    same = (F.col("_range") == F.col("_r")) & (F.col("_lane") == F.col("_l"))
    best = F.greatest("_best", "_carried") + F.col("_shift")
    return local.join(broadcast_if_small(carried), same).select(
        "id", "ts", F.timestamp_micros(best).alias("sent_at")
    )


def digest(
    matches: DataFrame, raw_items: DataFrame, n: int = fixed.DIGEST_SIZE
) -> DataFrame:
    """The first ``n`` waiting matches in queue order, with the number of all waiting ones."""
    waiting = matches.filter(F.col("status") == "digest_pending")
    first = waiting.orderBy("created_at", "id").limit(n)
    lines = first.join(
        raw_items.select(F.col("id").alias("raw_item_id"), "source", "permalink"), "raw_item_id"
    ).select(
        "id",
        "score",
        "source",
        F.left(
            F.coalesce(F.nullif("llm_summary_ru", F.lit("")), "headline"),
            F.lit(fixed.DIGEST_SUMMARY_CHARS),
        ).alias("summary"),
        "permalink",
        "created_at",
    )
    return with_total(lines, waiting).orderBy("created_at", "id")


def sources_listing(sources: DataFrame, now: Column) -> DataFrame:
    """Sources by category and name, with the flags off and muted."""
    flags = F.array_compact(
        F.array(
            F.when(~F.col("enabled"), "off"),
            F.when(F.col("muted_until") > now, "muted"),
        )
    )
    return sources.select(
        "category", "name", "priority", F.array_join(flags, ", ").alias("flags")
    ).orderBy("category", "name")


def active_sources(sources: DataFrame, circuit: str, seeds: DataFrame) -> DataFrame:
    """Enabled sources of a circuit by name; the seeds' if the table has none."""

    def chosen(table: DataFrame) -> DataFrame:
        return table.filter((F.col("circuit") == circuit) & F.col("enabled").eqNullSafe(True)).select(
            "name"
        )

    found = chosen(sources)
    none_found = found.agg(F.count("*") == 0).scalar()
    return found.unionByName(chosen(seeds).filter(none_found)).orderBy("name")


def cards(
    matches: DataFrame, raw_items: DataFrame, zone: str = "UTC"
) -> DataFrame:
    """Texts of the notification cards, one column per line of the card."""
    joined = matches.alias("m").join(
        raw_items.alias("r"), F.col("r.id") == F.col("m.raw_item_id")
    )
    has = set(matches.columns)
    verdict = "m.llm_verdict" if "llm_verdict" in has else None
    budget_hint = F.col(f"{verdict}.budget_hint") if verdict else F.lit(None).cast("string")
    red_flags = F.col(f"{verdict}.red_flags_ru") if verdict else F.lit(None).cast("array<string>")
    need = F.col(f"{verdict}.need_ru") if verdict else F.lit(None).cast("string")
    stack = F.col("m.stack_matched") if "stack_matched" in has else F.lit(None).cast("array<string>")
    summary = F.nullif(F.col("m.llm_summary_ru"), F.lit(""))
    return joined.select(
        "m.id",
        "m.headline",
        "m.score",
        decisions.intent_label(F.col("m.intent_tag")).alias("intent_label"),
        "r.source",
        "r.author_handle",
        F.date_format(F.from_utc_timestamp("r.posted_at", zone), "dd.MM HH:mm").alias("posted_local"),
        F.coalesce(summary, F.left("r.text", F.lit(fixed.CARD_EXCERPT_CHARS))).alias("body"),
        summary.isNull().alias("is_original"),
        F.nullif(need, F.lit("")).alias("need"),
        F.coalesce(F.nullif(budget_hint, F.lit("")), F.col("m.compensation")).alias("budget"),
        F.nullif(F.array_join(red_flags, ", "), F.lit("")).alias("flags"),
        F.nullif(
            F.array_join(F.slice(stack, 1, fixed.CARD_STACK_TERMS), " · "), F.lit("")
        ).alias("stack"),
        F.when(F.col("m.duplicate_count") > 0, F.col("m.duplicate_count")).alias("more_like_this"),
        F.when(F.col("m.decided_by") == "rules_only", F.col("m.llm_status")).alias("rules_only_note"),
    )


def score_explanation(matches: DataFrame) -> DataFrame:
    """(id, rule, points, label) per fired rule, the label with its sign."""
    # The outer form: the inner one adds a filter on the map, which would move below the
    # projection that builds the map and compute it twice.
    rows = matches.select("id", F.explode_outer("signals").alias("rule", "points")).filter(
        F.col("rule").isNotNull()
    )
    sign = F.when(F.col("points") >= 0, "+").otherwise("")
    return rows.withColumn("label", F.concat(sign, F.col("points").cast("string")))


def retained(raw_items: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Items that stay: all but rejected ones created before ``now - days``."""
    old = F.col("created_at") < now - F.make_dt_interval(days=F.lit(days))
    return raw_items.filter(~(F.col("reject_rule").isNotNull() & F.coalesce(old, F.lit(False))))
