"""Structured Streaming jobs over the same operators as batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import fixed_values as fixed
from gleaner import schemas
from gleaner.operators import admin, dedup, flow
from gleaner.operators.dedup import mark_duplicates
from gleaner.operators.items import drop_stale
from gleaner.rules import RuleSet
from gleaner.session import broadcast_if_small, cut_lineage, scratch, with_keys_of
from gleaner.sources import messages, sinks

RAW_TABLE = schemas.RAW_ITEMS + ", ts TIMESTAMP, ingest_date DATE"
DUPLICATES_TABLE = "id BIGINT, duplicate_of BIGINT"


def edge(
    items: DataFrame,
    late_minutes: int = fixed.MAX_ITEM_AGE_MINUTES,
    id_days: int = fixed.ITEM_ID_LOOKBACK_DAYS,
    now: Column | None = None,
) -> DataFrame:
    """Items entering the stream: too old ones dropped, each item id once in ``id_days``."""
    fresh = items if now is None else drop_stale(items, now, late_minutes)
    return fresh.withWatermark("posted_at", f"{id_days} days").dropDuplicatesWithinWatermark(
        ["item_id"]
    )


def with_ids(batch: DataFrame, batch_id: int) -> DataFrame:
    """Add a unique ``id``; ids of a later batch are larger.

    The batch is written once before it is numbered, so the numbers do not change when a task
    runs again.  Only the row count of each task is gathered.
    """
    placed = cut_lineage(
        batch.withColumns(
            {
                "_part": F.spark_partition_id(),
                "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per task of the batch.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(broadcast_if_small(starts), "_part")
        .withColumn("id", F.lit(batch_id << 40) + F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


@dataclass(frozen=True)
class Tables:
    """What a micro-batch reads; each entry is called once per batch, so edits take effect."""

    rules: Callable[[], RuleSet]
    sources: Callable[[], DataFrame]
    authors: Callable[[], DataFrame]


@dataclass(frozen=True)
class Edge:
    """What may enter the store: how late an item may be, and how long its id stays registered."""

    late_minutes: int = fixed.MAX_ITEM_AGE_MINUTES
    id_days: int = fixed.ITEM_ID_LOOKBACK_DAYS


REGISTERED = "item_id STRING, ts TIMESTAMP, day DATE"
TURNED_AWAY = "id BIGINT, item_id STRING, source STRING, permalink STRING, posted_at TIMESTAMP"


ITEM_KEYS = "id BIGINT, ts TIMESTAMP, text_hash STRING, simhash BIGINT, day DATE"
NEAR_KEYS = (
    "simhash BIGINT, first STRUCT<ts: TIMESTAMP, id: BIGINT>, last TIMESTAMP, triple INT, kept BIGINT, "
    "period BIGINT, upto BIGINT, bucket INT"
)
BUCKETS = 16
PERIOD_BLOCKS = 8


def _bucket() -> Column:
    return F.pmod(F.xxhash64("triple", "kept"), F.lit(BUCKETS)).cast("int")


def write_index(keys: DataFrame, store: str, batch_id: int) -> None:
    """Write the duplicate index of a batch's items (id, ts, text_hash, simhash), once for each item.

    ``item_keys`` is one narrow row per item, in order of time; ``near_keys`` has the twenty keys of
    each hash, by a bucket of the key and by period: in folders named by the last of at most
    ``PERIOD_BLOCKS`` stretches of periods, so that their number does not grow with the time a batch spans.
    """
    dated = keys.withColumn("day", F.to_date("ts"))
    sinks.write_in_order(dated, f"{store}/item_keys", batch_id, ("ts", "id"))
    period = dedup.period_of(F.col("ts"), fixed.NEAR_LOOKBACK_DAYS)
    ends = keys.agg(F.min(period).alias("low"), F.max(period).alias("high")).first()
    upto = sinks.in_blocks(F.col("period"), ends["low"], ends["high"], PERIOD_BLOCKS)
    near = dedup.near_keys(keys).withColumns({"bucket": _bucket(), "upto": upto.cast("bigint")})
    laid = near.repartition("upto", "bucket").sortWithinPartitions("upto", "bucket", "period")
    sinks.write_batch(laid, f"{store}/near_keys", batch_id, ("upto", "bucket"))


def read_near_index(asked: DataFrame, store: str, batch_id: int) -> DataFrame:
    """The rows of the near index that may answer ``asked``: its buckets, and the periods in reach."""
    spark = asked.sparkSession
    own = sinks.read_table(spark, f"{store}/near_keys", NEAR_KEYS, batch_id + 1)
    own = own.filter(F.col("batch_id") == batch_id)
    # At most as many rows as there are buckets, and one.
    buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]
    if not buckets:
        return own
    oldest = own.agg(F.min("period")).first()[0]
    table = sinks.read_table(spark, f"{store}/near_keys", NEAR_KEYS, batch_id + 1)
    recent = (F.col("upto") >= oldest - 1) & (F.col("period") >= oldest - 1)
    return table.filter(F.col("bucket").isin(buckets) & recent)


def prune_near_index(spark: SparkSession, store: str, oldest_item: Column) -> int:
    """Delete the stretches of the near index that no item from ``oldest_item`` on can reach back to."""
    period = dedup.period_of(oldest_item, fixed.NEAR_LOOKBACK_DAYS)
    first = spark.range(1).select(period.alias("p")).first()["p"] - 1
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{store}/near_keys")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for batch in files.listStatus(root) if files.exists(root) else []:
        for part in files.listStatus(batch.getPath()):
            name = part.getPath().getName()
            if name.startswith("upto=") and int(name.removeprefix("upto=")) < first:
                files.delete(part.getPath(), True)
                dropped += 1
    return dropped


def latest_time(spark: SparkSession, store: str, batch_id: int):
    """The clock of the stream: the latest item time of earlier batches."""
    clock = sinks.read_table(spark, f"{store}/clock", "latest TIMESTAMP", batch_id)
    return clock.agg(F.max("latest")).first()[0]


def enter(numbered: DataFrame, batch_id: int, store: str, edge: Edge) -> DataFrame:
    """The items of a batch that may enter; the others go to the tables ``late`` and ``repeated``.

    Late is what was posted more than ``late_minutes`` before the clock of the stream.  Of the rest
    an item whose id is registered is a repetition; ids are registered for ``id_days`` by their first
    item and not renewed, in this batch and in earlier ones, whose registrations lie in order of time,
    so only files with days that a registration can reach from are read.  Items without an id are never repeated,
    those without a time are never late.  What the tables take and what goes on is the whole batch,
    and a repeated batch is divided alike.
    """
    spark = numbered.sparkSession
    latest = latest_time(spark, store, batch_id)
    posted = F.col("posted_at")
    clock = F.lit(latest).cast("timestamp")
    late = posted < clock - F.make_dt_interval(mins=F.lit(edge.late_minutes))
    marked = cut_lineage(
        numbered.withColumns(
            {
                "_late": F.coalesce(late, F.lit(False)),
                "ts": F.greatest(F.coalesce(posted, clock, F.timestamp_seconds(F.lit(0))), clock),
            }
        )
    )
    turned_away = [c.split(" ")[0] for c in TURNED_AWAY.split(", ")]
    sinks.write_batch(marked.filter("_late").select(*turned_away), f"{store}/late", batch_id)
    on_time = marked.filter("NOT _late AND item_id IS NOT NULL").select("item_id", "ts", "id")
    begin = on_time.agg(F.min("ts")).first()[0]
    reach = F.lit(begin).cast("timestamp") - F.make_dt_interval(days=F.lit(edge.id_days))
    known = sinks.read_table(spark, f"{store}/registered", REGISTERED, batch_id)
    valid = known.filter((F.col("day") >= F.to_date(reach)) & (F.col("ts") >= reach)).select("item_id", "ts")
    standing = with_keys_of(valid, on_time, ["item_id"]).groupBy("item_id").agg(F.max("ts").alias("ts"))
    # Registrations get negative ids of their own, so that none is mistaken for an item.
    standing = standing.withColumn("id", -1 - F.monotonically_increasing_id())
    events = cut_lineage(standing.unionByName(on_time))
    firsts = cut_lineage(admin.first_seen(events, "item_id", edge.id_days).filter("id >= 0"))
    new = firsts.filter("is_first").select("item_id", "ts", F.to_date("ts").alias("day"))
    sinks.write_in_order(new, f"{store}/registered", batch_id, ("ts", "item_id"))
    again = broadcast_if_small(firsts.filter("NOT is_first").select("id"))
    repeated = marked.join(again, "id", "left_semi")
    sinks.write_batch(repeated.select(*turned_away), f"{store}/repeated", batch_id)
    entered = marked.filter("NOT _late").join(again, "id", "left_anti")
    return entered.select(*numbered.columns)


def store_batch(
    numbered: DataFrame,
    batch_id: int,
    store: str,
    tables: Tables,
    now: Column | None = None,
    classifier_on: bool = True,
    token_hash: str = "blake2b",
    zone: str = "UTC",
) -> None:
    """Process the items of one micro-batch, numbered by ``with_ids``, into the store.

    An item's time is when it was posted, but never before the latest time of earlier batches:
    whatever came in earlier counts as earlier, and a repeated batch gets the same times.  Items
    without a time go to the table ``untimed``.  Routes follow the clock of ``zone`` at the moment
    of the decision.

    The text is written once, with the outcome of the rules; that a row is a duplicate is kept
    in a narrow table of its own (see ``read_raw_items``).
    """
    spark = numbered.sparkSession
    untimed = numbered.filter("posted_at IS NULL").withColumn("problem", F.lit("no_posted_at"))
    sinks.write_batch(untimed, f"{store}/untimed", batch_id)
    numbered = numbered.filter("posted_at IS NOT NULL")
    latest = latest_time(spark, store, batch_id)
    posted = F.col("posted_at")
    arrival = posted if latest is None else F.greatest(posted, F.lit(latest))
    items = numbered.withColumn("ts", arrival)
    bounds = items.agg(F.min("ts").alias("first"), F.max("ts").alias("latest")).first()
    if bounds["first"] is None:
        return
    rules = tables.rules()
    moment = F.current_timestamp() if now is None else now
    analysed = flow.analyse(items, tables.sources(), rules, moment, token_hash)
    raw_table = f"{store}/raw_items"
    sinks.write_raw_items(analysed.withColumn("created_at", F.col("ts")), raw_table, batch_id)
    facts = spark.read.parquet(raw_table).filter(F.col("batch_id") == batch_id)
    keys = facts.select("id", "ts", "text_hash", "simhash")
    write_index(keys, store, batch_id)
    reach = F.make_dt_interval(days=F.lit(fixed.EXACT_LOOKBACK_DAYS))
    index = sinks.read_table(spark, f"{store}/item_keys", ITEM_KEYS, batch_id)
    index = index.filter(F.col("day") >= F.to_date(F.lit(bounds["first"]) - reach))
    near_index = read_near_index(keys, store, batch_id)
    result = flow.resolve(
        facts, tables.authors(), rules, index, classifier_on, zone, moment, near_index
    )
    sinks.write_batch(result.duplicates, f"{store}/duplicates", batch_id)
    sinks.write_batch(result.work, f"{store}/work", batch_id)
    sinks.write_matches(result.matches, f"{store}/matches", batch_id)
    sinks.write_batch(
        spark.createDataFrame([(bounds["latest"],)], "latest TIMESTAMP"), f"{store}/clock", batch_id
    )


def read_raw_items(spark: SparkSession, store: str) -> DataFrame:
    """Stored items with ``duplicate_of``, and 'duplicate' before every other reject rule."""
    raw = sinks.read_table(spark, f"{store}/raw_items", RAW_TABLE)
    found = sinks.read_table(spark, f"{store}/duplicates", DUPLICATES_TABLE)
    return mark_duplicates(raw, found)


def run_items(
    items: DataFrame,
    store: str,
    checkpoint: str,
    tables: Tables,
    edge: Edge | None = None,
    **settings,
) -> StreamingQuery:
    """Stream of items into the store; processes what is there and stops.

    With an ``edge`` late and repeated items are turned away first.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        numbered = with_ids(batch, batch_id)
        entered = enter(numbered, batch_id, store, edge) if edge else numbered
        store_batch(entered, batch_id, store, tables, **settings)

    return _run(items, handle, checkpoint)


def run_messages(
    raw: DataFrame,
    store: str,
    checkpoint: str,
    tables: Tables,
    edge: Edge | None = None,
    **settings,
) -> StreamingQuery:
    """Stream of JSON messages; unusable ones go to the quarantine table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = with_ids(messages.parse_messages(batch), batch_id)
        sinks.write_batch(messages.bad_messages(parsed), f"{store}/quarantine", batch_id)
        good = messages.good_items(parsed)
        entered = enter(good, batch_id, store, edge) if edge else good
        store_batch(entered, batch_id, store, tables, **settings)

    return _run(raw, handle, checkpoint)


def _run(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    def handle_and_clean(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            handle(batch, batch_id)

    return (
        stream.writeStream.foreachBatch(handle_and_clean)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def duplicate_updates(duplicates: DataFrame) -> DataFrame:
    """Running duplicate count per original; write it in update mode."""
    return duplicates.groupBy(F.col("duplicate_of").alias("raw_item_id")).agg(
        F.count("*").alias("duplicate_count")
    )


def call_windows(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls per circuit and calendar minute as a stream, for the quota counters."""
    return (
        calls.withWatermark("ts", late)
        .groupBy("circuit", F.window("ts", "1 minute").alias("minute"))
        .agg(F.count("*").alias("calls"))
        .select("circuit", F.col("minute.start").alias("minute"), "calls")
    )


def last_beats(beats: DataFrame) -> DataFrame:
    """Last heartbeat per circuit as a stream in update mode; ``reports.silent_circuits`` reads
    the table it is written to."""
    return beats.groupBy("circuit").agg(F.max("ts").alias("ts"))


def to_deliver(matches: DataFrame, settings: DataFrame) -> DataFrame:
    """Matches to send now: none while the settings row ``paused`` is on; they stay queued."""
    paused = settings.filter((F.col("key") == "paused") & F.col("value").eqNullSafe("1"))
    is_paused = paused.agg(F.count("*") > 0).scalar()
    return matches.filter((F.col("status") == "new") & ~is_paused)


def digest_day(at: Column, end: str = fixed.QUIET_END, zone: str = "UTC") -> Column:
    """The day whose digest holds an item: digests go out when quiet hours end."""
    hours, minutes = (int(x) for x in end.split(":"))
    local = F.from_utc_timestamp(at, zone)
    shift = F.make_dt_interval(hours=F.lit(hours), mins=F.lit(minutes))
    return F.date_add(F.to_date(local - shift), 1)


def read_store(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}")
