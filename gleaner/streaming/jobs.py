"""Jobs over the stored tables: sending, digests, verdict passes, card updates, retention.

Runs of a job are numbered.  A run owns the folder ``batch_id=N`` of each table it writes and reads
of its own tables only what earlier runs have written, so a run that is repeated after a failure
leaves the same rows.  Stored matches are never rewritten: status changes are a log of events, and
verdicts are later versions of the rows they change.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import fixed_values as fixed
from gleaner import schemas
from gleaner.functions.decisions import route_queue
from gleaner.operators import admin, reports, verdicts
from gleaner.rules import RuleSet
from gleaner.session import broadcast_if_small, cut_lineage, path_exists
from gleaner.sources import sinks
from gleaner.streaming import ingest

EVENTS = "id BIGINT, match_id BIGINT, ts TIMESTAMP, status STRING"
DELIVERIES = "match_id BIGINT, requested_at TIMESTAMP, sent_at TIMESTAMP"
VERDICTS = f"id BIGINT, outcome STRING, verdict {schemas.VERDICT}"
UPDATES = "match_id BIGINT, raw_item_id BIGINT, duplicate_count BIGINT"
SENDING, DIGEST = "sending", "digest"


def with_status(matches: DataFrame, store: str, job: str, run: int) -> DataFrame:
    """Matches with the status that the events of all jobs leave, as run ``run`` of ``job`` sees it."""
    spark = matches.sparkSession
    logs = [
        sinks.read_table(spark, f"{store}/events/{name}", EVENTS, run if name == job else None)
        for name in (SENDING, DIGEST)
    ]
    return admin.match_status(matches, functools.reduce(DataFrame.unionAll, logs))


def _notified(sent: DataFrame, store: str, job: str, run: int) -> None:
    """Append a ``notified`` event for each row (match_id, sent_at)."""
    events = sent.select(
        F.col("match_id").alias("id"), "match_id", F.col("sent_at").alias("ts"), F.lit("notified").alias("status")
    )
    sinks.write_batch(events, f"{store}/events/{job}", run)


# --- sending, pause and resume ---------------------------------------------------------------


def send_waiting(
    matches: DataFrame,
    store: str,
    run: int,
    now: Column,
    settings: DataFrame,
    limit: int = fixed.SENDS_PER_MINUTE,
    seconds: int = 60,
) -> DataFrame:
    """Send what waits: (match_id, requested_at, sent_at), at most ``limit`` in any ``seconds`` seconds.

    While the settings row ``paused`` is on nothing is sent and the queue stays as it is; the next
    run without a pause sends each waiting match once.  The log of deliveries is the cursor: what it
    holds is never sent again, and its last ``limit`` sends count for the cap.
    """
    spark = matches.sparkSession
    queued = ingest.to_deliver(with_status(matches, store, SENDING, run), settings)
    waiting = queued.filter(F.col("created_at") <= now).select(
        "id", "created_at", F.greatest("created_at", now).alias("ts"), F.lit(False).alias("sent")
    )
    log = sinks.read_table(spark, f"{store}/deliveries", DELIVERIES, run)
    last = log.orderBy(F.desc("sent_at"), F.desc("match_id")).limit(limit)
    # The queue is first in, first out: what has been given a time goes before all that is new.
    before = last.select(-1 - F.col("match_id"), "requested_at", F.col("sent_at").alias("ts"), F.lit(True))
    taken = log.agg(F.max("sent_at")).first()[0]
    waiting = waiting.withColumn("ts", F.greatest("ts", F.lit(taken).cast("timestamp")))
    requests = cut_lineage(waiting.unionAll(before))
    times = reports.send_times(requests.select("id", "ts"), limit, seconds)
    new = requests.filter("NOT sent").select("id", "created_at").join(times, "id")
    sent = cut_lineage(
        new.select(F.col("id").alias("match_id"), F.col("created_at").alias("requested_at"), "sent_at")
    )
    sinks.write_batch(sent, f"{store}/deliveries", run)
    _notified(sent, store, SENDING, run)
    return sent


# --- digest ----------------------------------------------------------------------------------


def send_digest(
    matches: DataFrame,
    raw_items: DataFrame,
    store: str,
    run: int,
    now: Column,
    n: int = fixed.DIGEST_SIZE,
    zone: str = "UTC",
) -> DataFrame:
    """The lines of one digest: the first ``n`` matches that are due, with the number of all due ones.

    A match is due from the day on whose quiet hours it waited for.  What the digest shows becomes
    ``notified``; the rest stays pending for the next one.
    """
    current = with_status(matches, store, DIGEST, run)
    today = F.to_date(F.from_utc_timestamp(now, zone))
    due = current.filter(ingest.digest_day(F.col("created_at"), zone=zone) <= today)
    lines = cut_lineage(reports.digest(due, raw_items, n).withColumn("sent_at", now))
    sinks.write_batch(lines, f"{store}/digests", run)
    _notified(lines.select(F.col("id").alias("match_id"), "sent_at"), store, DIGEST, run)
    return lines


# --- verdicts --------------------------------------------------------------------------------


def open_work(spark: SparkSession, store: str, run: int | None = None) -> DataFrame:
    """The stored work list without the items that earlier passes have settled."""
    settled = sinks.read_table(spark, f"{store}/verdicts", VERDICTS, run).select("id")
    return spark.read.parquet(f"{store}/work").join(settled, "id", "left_anti")


def read_matches(spark: SparkSession, store: str, run: int | None = None) -> DataFrame:
    """Stored matches, each in its last version: as judged by a pass, else as first stored."""
    stored = spark.read.parquet(f"{store}/matches").drop("batch_id")
    if not path_exists(spark, f"{store}/judged"):
        return stored
    judged = sinks.read_table(spark, f"{store}/judged", _columns(stored), run).drop("batch_id")
    return stored.join(judged.select("id"), "id", "left_anti").unionByName(judged)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def judge(
    spark: SparkSession,
    store: str,
    run: int,
    classifier: verdicts.Classifier,
    rules: RuleSet,
    now: Column,
    circuits_left: DataFrame | None = None,
    zone: str = "UTC",
    model: str = "",
) -> DataFrame:
    """One pass of the classifier over what is open: the matches it settles, in their new version.

    ``classifier`` gets the open work and returns (id, response); an item without a response stays
    open.  ``circuits_left`` (circuit, calls) says how many calls each circuit has left; beyond it,
    by id, items are not asked but settled by the rules, as the quota is not waited for.
    """
    work = cut_lineage(open_work(spark, store, run))
    asked, refused = work, None
    if circuits_left is not None:
        most = circuits_left.agg(F.max("calls")).first()[0] or 0
        place = F.row_number().over(Window.partitionBy("circuit").orderBy("id"))
        # At most as many rows per circuit as calls are left, which Spark cuts before the shuffle.
        first = work.select("id", "circuit").withColumn("_place", place).filter(F.col("_place") <= most)
        # The table of calls left has one row per circuit.
        within = F.col("_place") <= F.coalesce("calls", F.lit(0))
        passed = broadcast_if_small(
            first.join(F.broadcast(circuits_left), "circuit").filter(within).select("id")
        )
        asked = work.join(passed, "id", "left_semi")
        refused = work.join(passed, "id", "left_anti").select(
            "id", F.lit("quota_exhausted").alias("outcome"), F.lit(None).cast(schemas.VERDICT).alias("verdict")
        )
    answers = verdicts.parse_responses(classifier(asked)).select("id", "outcome", "verdict")
    # Only answers to what was asked, one per item.
    answers = answers.join(asked.select("id"), "id", "left_semi").dropDuplicates(["id"])
    rows = cut_lineage(answers if refused is None else answers.unionByName(refused))
    sinks.write_batch(rows, f"{store}/verdicts", run)
    calls = rows.join(work.select("id", "mode", "circuit"), "id").select(
        F.col("id").alias("match_id"),
        "mode",
        "circuit",
        F.lit(None).cast("string").alias("model"),
        "outcome",
        *[F.lit(None).cast("bigint").alias(c) for c in ("prompt_tokens", "output_tokens", "latency_ms")],
        F.when(F.col("outcome") == "error", "unreadable").alias("error"),
        now.alias("created_at"),
    )
    sinks.write_usage(calls, f"{store}/usage", run, model)
    waiting = read_matches(spark, store, run).join(rows.select("id"), "id", "left_semi")
    settled = cut_lineage(verdicts.judge_stored(cut_lineage(waiting), rows, now, rules, zone))
    stored = spark.read.parquet(f"{store}/matches").drop("batch_id")
    derived = {
        "queue": route_queue(F.col("status")),
        "rules_notify": F.col("score") >= rules.notify_threshold,
        "will_notify": F.col("status").isin("new", "digest_pending"),
    }
    routed = settled.select(
        *[F.col(c) if c in settled.columns else derived[c].alias(c) for c in stored.columns]
    )
    sinks.write_batch(routed, f"{store}/judged", run)
    return routed


# --- updates of delivered cards --------------------------------------------------------------


def card_updates(
    duplicates: DataFrame,
    matches: Callable[[], DataFrame],
    store: str,
    checkpoint: str,
) -> StreamingQuery:
    """Stream of duplicates (id, duplicate_of) into the table ``card_updates`` of changed cards.

    The running count per original is kept by the stream; each micro-batch writes one row for every
    match whose count has changed in it, and nothing else.  ``current_counts`` folds the table.
    """

    def store_changes(changed: DataFrame, batch_id: int) -> None:
        found = matches().select(F.col("id").alias("match_id"), "raw_item_id")
        rows = found.join(broadcast_if_small(changed), "raw_item_id").select("match_id", "raw_item_id", "duplicate_count")
        sinks.write_batch(rows, f"{store}/card_updates", batch_id)

    return (
        ingest.duplicate_updates(duplicates)
        .writeStream.foreachBatch(store_changes)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, store: str) -> DataFrame:
    """(match_id, raw_item_id, duplicate_count) after the last update of each card."""
    log = sinks.read_table(spark, f"{store}/card_updates", UPDATES)
    return log.groupBy("match_id", "raw_item_id").agg(
        F.max_by("duplicate_count", "batch_id").alias("duplicate_count")
    )


# --- retention and compaction ----------------------------------------------------------------


def compact(spark: SparkSession, store: str, upto: int, now: Column, days: int = fixed.RETENTION_DAYS) -> int:
    """Rewrite the items of batches up to ``upto``: retention applied, one file per day and circuit.

    The new version is written beside the old files and becomes visible by one marker, so readers
    see either all of the old or all of the new.  Files of the version before last are deleted by
    ``drop_replaced`` when no reader can hold them any more.  Returns the number of the version.
    """
    table = f"{store}/raw_items"
    current, _ = sinks.current_version(spark, table)
    version = current + 1
    seen = sinks.read_table(spark, table, ingest.RAW_TABLE, upto + 1)
    duplicates = sinks.read_table(spark, f"{store}/duplicates", ingest.DUPLICATES_TABLE)
    copies = duplicates.select("id", F.lit("duplicate").alias("_rule"))
    marked = seen.join(broadcast_if_small(copies), "id", "left")
    # A duplicate counts as rejected, though its rule is in the table of duplicates.
    rejected = marked.withColumn("_own", F.col("reject_rule")).withColumn(
        "reject_rule", F.coalesce("_rule", "reject_rule")
    )
    kept = reports.retained(rejected, now, days).withColumn("reject_rule", F.col("_own"))
    even = kept.drop("_own", "_rule").repartition("ingest_date", "circuit")
    sinks.write_version(even, table, version, upto, ("ingest_date", "circuit"))
    return version
