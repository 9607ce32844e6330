"""Jobs over the store: repeated runs, pauses, versions."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import dedup
from gleaner.rules import RuleReader, publish_rules, seed_keywords, seed_rule_weights, seed_rules
from gleaner.sources import sinks
from gleaner.streaming import ingest, jobs

T0 = dt.datetime(2024, 1, 1)


def moment(text):
    return F.to_timestamp(F.lit(text))


def matches_of(spark, rows):
    """rows: (id, status, minutes after T0)."""
    return spark.createDataFrame(
        [(i, i, s, T0 + dt.timedelta(minutes=m), None, 12, "h", "") for i, s, m in rows],
        "id bigint, raw_item_id bigint, status string, created_at timestamp, notified_at timestamp, score int, "
        "headline string, llm_summary_ru string",
    )


def test_digests_send_each_match_once_and_repeat_alike(spark, tmp_path):
    matches = matches_of(spark, [(i, "digest_pending" if i % 2 else "new", i) for i in range(150)])
    raw = matches.select("id", F.lit("s").alias("source"), F.lit("p").alias("permalink"))
    store = str(tmp_path)

    def shown(run):
        return [r.id for r in sorted(jobs.send_digest(matches, raw, store, run, moment(f"2024-01-0{run + 1} 09:00:00")).collect(), key=lambda r: r.id)]

    first, second = shown(0), shown(1)
    assert len(first) == len(second) == 30 and not set(first) & set(second)
    assert shown(1) == second and shown(2) == [i for i in range(150) if i % 2][60:]
    status = {r.id: r.status for r in jobs.with_status(matches, store, jobs.DIGEST, 9).collect()}
    assert sum(s == "notified" for s in status.values()) == 75 and status[0] == "new"


def test_a_pause_keeps_the_queue(spark, tmp_path):
    matches = matches_of(spark, [(i, "new", i) for i in range(30)] + [(99, "suppressed", 0)])
    on = spark.createDataFrame([("paused", "1")], "key string, value string")
    sent = {}
    for name, paused in (("with", {1}), ("without", set())):
        sent[name] = []
        for run, minute in enumerate((10, 20, 40)):
            settings = on if run in paused else on.filter("false")
            now = moment(f"2024-01-01 00:{minute}:00")
            rows = jobs.send_waiting(matches, str(tmp_path / name), run, now, settings, limit=4)
            sent[name].append([(r.match_id, r.sent_at) for r in rows.collect()])
    assert sent["with"][1] == [] and [len(x) for x in sent["without"]] == [11, 10, 9]
    every = {n: sorted(i for run in runs for i, _ in run) for n, runs in sent.items()}
    assert every["with"] == every["without"] == list(range(30))
    for runs in sent.values():
        times = sorted(t for run in runs for _, t in run)
        assert all(b - a >= dt.timedelta(seconds=60) for a, b in zip(times, times[4:], strict=False))
    # The sends of the run before count for the cap.
    late = matches_of(spark, [(100 + i, "new", 0) for i in range(2)])
    again = jobs.send_waiting(late, str(tmp_path / "with"), 3, moment("2024-01-01 00:40:30"), on.filter("false"), limit=4)
    last = max(t for _, t in sent["with"][2])
    times = sorted([t for _, t in sent["with"][2]] + [r.sent_at for r in again.collect()])
    assert times[-2] >= last and all(b - a >= dt.timedelta(seconds=60) for a, b in zip(times, times[4:], strict=False))


def test_verdict_passes_repeat_and_end(spark, tmp_path):
    store = str(tmp_path)
    match = {name: None for name in ("signals", "stack_matched", "compensation", "contact", "llm_verdict")}
    columns = schemas.MATCHES + ", mode STRING, queue STRING, ts TIMESTAMP"
    names = [c.split(" ")[0] for c in spark.createDataFrame([], columns).columns]
    rows = []
    for i in range(8):
        row = {n: None for n in names} | match | {
            "id": i, "raw_item_id": i, "circuit": "main", "score": 20, "decided_by": "rules", "created_at": T0, "ts": T0,
            "llm_status": "pending" if i < 6 else "not_needed", "mode": "translate" if i < 6 else None,
            "status": "awaiting_llm" if i < 6 else "new", "intent_tag": "unknown", "duplicate_count": 0, "is_favorite": False,
        }
        rows.append(tuple(row[n] for n in names))
    sinks.write_matches(spark.createDataFrame(rows, columns), f"{store}/matches", 0)
    work = spark.createDataFrame([(i, "main", "translate", "", "strict", "t") for i in range(6)],
                                 "id bigint, circuit string, mode string, rule_hint string, prompt_variant string, item_text string")
    sinks.write_batch(work, f"{store}/work", 0)
    asked = []

    def classifier(open_work):
        asked.append(sorted(r.id for r in open_work.collect()))
        answer = F.when(F.col("id") == 1, "no verdict").otherwise('{"is_lead": true, "confidence": 0.9, "lead_type": "pain_point", "summary_ru": "s"}')
        return open_work.filter("id <> 5").select("id", answer.alias("response"))

    left = spark.createDataFrame([("main", 3)], "circuit string, calls int")
    now = moment("2024-01-02 12:00:00")
    for run in (0, 0, 1, 2):
        jobs.judge(spark, store, run, classifier, seed_rules(), now, left if run == 0 else None)
    assert asked == [[0, 1, 2], [0, 1, 2], [], []]
    final = {r.id: r for r in jobs.read_matches(spark, store).collect()}
    assert {i: r.llm_status for i, r in final.items()} == {
        0: "done", 1: "failed", 2: "done", 3: "skipped_quota", 4: "skipped_quota", 5: "skipped_quota", 6: "not_needed", 7: "not_needed"
    }
    assert final[0].intent_tag == "pain_point" and final[0].queue == "notify" and final[3].decided_by == "rules_only"
    usage = sinks.read_table(spark, f"{store}/usage", schemas.USAGE_LOG).collect()
    assert sorted(u.match_id for u in usage) == list(range(6))


def test_an_item_without_an_answer_stays_open(spark, tmp_path):
    work = spark.createDataFrame([(1, "main"), (2, "main")], "id bigint, circuit string")
    sinks.write_batch(work, f"{tmp_path}/work", 0)
    rows = spark.createDataFrame([(1, "ok", None)], jobs.VERDICTS)
    sinks.write_batch(rows, f"{tmp_path}/verdicts", 3)
    assert [r.id for r in jobs.open_work(spark, str(tmp_path)).collect()] == [2]
    assert jobs.open_work(spark, str(tmp_path), 3).count() == 2


def test_compaction_switches_at_once(spark, tmp_path):
    store = str(tmp_path)
    rows = [(i, "s", "main" if i % 2 else "browse", T0 + dt.timedelta(days=i % 3), "HF-1_length" if i % 4 == 0 else None) for i in range(60)]
    items = spark.createDataFrame(rows, "id bigint, source string, circuit string, created_at timestamp, reject_rule string").withColumn("ts", F.col("created_at"))
    for batch in range(3):
        sinks.write_raw_items(items.filter(F.col("id") % 3 == batch), f"{store}/raw_items", batch)
    sinks.write_batch(spark.createDataFrame([(1, 0)], ingest.DUPLICATES_TABLE), f"{store}/duplicates", 0)
    before = {r.id for r in ingest.read_raw_items(spark, store).collect()}
    assert len(before) == 60
    reader = ingest.read_raw_items(spark, store)
    assert jobs.compact(spark, store, 1, moment("2024-02-01 12:00:00")) == 1
    gone = {i for i, _, _, at, rule in rows if i % 3 < 2 and at < T0 + dt.timedelta(days=1, hours=12) and (rule or i == 1)}
    assert {r.id for r in ingest.read_raw_items(spark, store).collect()} == before - gone and gone
    assert {r.id for r in reader.collect()} == before  # who began before the switch reads on
    parts = glob.glob(f"{store}/raw_items-versions/version=1/ingest_date=*/circuit=*")
    assert parts and all(len(glob.glob(f"{p}/*.parquet")) == 1 for p in parts)
    # A version that was not finished does not count and is written again.
    items.limit(1).write.parquet(f"{store}/raw_items-versions/version=2")
    assert {r.id for r in ingest.read_raw_items(spark, store).collect()} == before - gone
    assert jobs.compact(spark, store, 2, moment("2024-02-01 12:00:00")) == 2
    sinks.drop_replaced(spark, f"{store}/raw_items", keep=1)
    assert not glob.glob(f"{store}/raw_items/batch_id=*") and not glob.glob(f"{store}/raw_items-versions/version=1")
    late = {i for i, _, _, at, rule in rows if at < T0 + dt.timedelta(days=1, hours=12) and (rule or i == 1)}
    assert {r.id for r in ingest.read_raw_items(spark, store).collect()} == before - late
    with pytest.raises(ValueError):
        sinks.write_version(items, f"{store}/raw_items", 2, 2)


def test_card_updates_hold_changed_cards_only(spark, tmp_path):
    store = str(tmp_path)
    matches = spark.createDataFrame([(10, 1), (20, 2)], "id bigint, raw_item_id bigint")
    for batch, found in enumerate([[(3, 1), (4, 2)], [(5, 1)], [(6, 9)]]):
        sinks.write_batch(spark.createDataFrame(found, ingest.DUPLICATES_TABLE), f"{store}/duplicates", batch)
        stream = spark.readStream.schema(f"{ingest.DUPLICATES_TABLE}, batch_id BIGINT").parquet(f"{store}/duplicates")
        jobs.card_updates(stream, lambda: matches, store, f"{store}/check").awaitTermination()
    log = sinks.read_table(spark, f"{store}/card_updates", jobs.UPDATES).collect()
    assert sorted((r.batch_id, r.match_id, r.duplicate_count) for r in log) == [(0, 10, 1), (0, 20, 1), (1, 10, 2)]
    assert {(r.match_id, r.duplicate_count) for r in jobs.current_counts(spark, store).collect()} == {(10, 2), (20, 1)}


def test_rules_are_read_again_only_when_published(spark, tmp_path):
    folder = str(tmp_path)
    reader = RuleReader(spark, folder)
    assert reader().stack == {}
    publish_rules(spark, folder, seed_keywords(spark), seed_rule_weights(spark))
    first = reader()
    assert first.version == "v1" and first.stack == seed_rules().stack and reader() is first
    publish_rules(spark, folder, seed_keywords(spark).filter("dict_type <> 'money'"), seed_rule_weights(spark))
    assert reader().version == "v2" and not reader().money


def test_the_edge_turns_late_and_repeated_items_away(spark, tmp_path):
    store = str(tmp_path)
    at = {n: T0 + dt.timedelta(hours=n) for n in (0, 1, 2, 20, 30, 200)}
    batches = [
        [("a", at[0]), ("b", at[1]), ("a", at[1]), ("x", None), ("x", None)],
        [("a", at[20]), ("c", at[20]), (None, at[20]), (None, at[20])],
        [("d", at[2]), ("e", at[20]), ("b", at[200])],  # more than six hours before the clock; within; after a week
        [("z", at[2])],  # nothing enters
    ]
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame([(i, "s", "p", t) for i, t in rows], "item_id string, source string, permalink string, posted_at timestamp")
        for _ in range(2):  # a repeated batch is divided alike
            entered = ingest.enter(ingest.with_ids(batch, number), number, store, ingest.Edge()).collect()
            latest = spark.createDataFrame([(max(t for _, t in rows if t),)], "latest timestamp")
            sinks.write_batch(latest, f"{store}/clock", number)
        names = sorted(str(r.item_id) for r in entered)
        assert names == [["a", "b", "x"], ["None", "None", "c"], ["b", "e"], []][number]
    away = {name: sorted(r.item_id for r in sinks.read_table(spark, f"{store}/{name}", ingest.TURNED_AWAY).collect()) for name in ("late", "repeated")}
    assert away == {"late": ["d", "z"], "repeated": ["a", "a", "x"]}


def test_near_look_up_stores_rows_in_proportion(spark, monkeypatch):
    """A dense cluster: every hash near every other.  No stored table grows with the pairs."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        h = 0
        for bit in rng.sample(range(12), rng.randrange(2)):
            h ^= 1 << bit
        h ^= 1 << (20 + i % 40)
        rows.append((i, T0 + dt.timedelta(minutes=i), f"t{i}", h))
    items = spark.createDataFrame(rows, "id bigint, ts timestamp, text_hash string, simhash bigint")
    sizes, original = [], dedup.cut_lineage

    def counting(df):
        stored = original(df)
        sizes.append(stored.count())
        return stored

    monkeypatch.setattr(dedup, "cut_lineage", counting)
    found = {r.id: r.original for r in dedup.near_originals(items, crowded=16).collect()}
    hashes = {i: h for i, _, _, h in rows}
    for i in (50, 399):
        same = [j for j in range(i) if hashes[j] == hashes[i]]
        near = [j for j in range(i) if bin(hashes[j] ^ hashes[i]).count("1") <= 3]
        assert found[i] == (same[0] if same else near[0])
    pairs = sum(bin(a ^ b).count("1") <= 3 for a in set(hashes.values()) for b in set(hashes.values()))
    assert max(sizes) <= 4 * len(rows) < pairs / 4


def test_the_near_index_is_pruned_by_period(spark, tmp_path):
    store = str(tmp_path)
    rows = [(i, T0 + dt.timedelta(days=20 * i), f"t{i}", i << 20) for i in range(4)]
    keys = spark.createDataFrame(rows, "id bigint, ts timestamp, text_hash string, simhash bigint")
    ingest.write_index(keys, store, 0)
    whole = sinks.read_table(spark, f"{store}/near_keys", ingest.NEAR_KEYS)
    assert whole.count() == 4 * 20
    late = keys.filter("id = 3")
    ingest.write_index(late, store, 1)
    assert {r.first.id for r in ingest.read_near_index(late, store, 1).select("first").collect()} == {3}
    assert ingest.prune_near_index(spark, store, moment("2024-03-01 00:00:00")) > 0
    assert {r.first.id for r in sinks.read_table(spark, f"{store}/near_keys", ingest.NEAR_KEYS).select("first").collect()} == {3}


def test_files_of_a_batch_do_not_grow_with_its_days(spark, tmp_path):
    """A batch of 600 days and one of 1,200: as many files, and a reader still skips by time."""
    store = str(tmp_path)
    n, files = F.col("id"), {}
    for batch, days in enumerate((600, 1200)):
        rows = spark.range(days).select(
            "id", F.timestamp_seconds(n * 86_400).alias("ts"), F.sha2(n.cast("string"), 256).alias("text_hash"),
            F.xxhash64("id").alias("simhash"),
        )
        ingest.write_index(rows, store, batch)
        items = rows.withColumns({"circuit": F.lit("main"), "created_at": F.col("ts"), "item_id": n.cast("string")})
        sinks.write_raw_items(items, f"{store}/raw_items", batch)
        posted = items.select("item_id", F.lit("s").alias("source"), F.lit("p").alias("permalink"), "id", F.col("ts").alias("posted_at"))
        ingest.enter(posted, batch, store, ingest.Edge())
        for name in ("item_keys", "near_keys", "raw_items", "registered"):
            files[name, batch] = len(glob.glob(f"{store}/{name}/batch_id={batch}/**/*.parquet", recursive=True))
    for name in ("item_keys", "near_keys", "raw_items", "registered"):
        most = ingest.PERIOD_BLOCKS * ingest.BUCKETS if name == "near_keys" else 64
        assert 0 < files[name, 1] <= most, files
    whole = sinks.read_table(spark, f"{store}/raw_items", "id BIGINT, ingest_date DATE")
    assert whole.filter("ingest_date = id * INTERVAL '1' DAY + DATE'1970-01-01'").count() == 1800
    late = spark.createDataFrame([(5000, dt.datetime(1973, 4, 1), "x", 1)], "id bigint, ts timestamp, text_hash string, simhash bigint")
    ingest.write_index(late, store, 2)
    met = ingest.read_near_index(late, store, 2).select(F.min("period"), F.max("period")).first()
    assert (met[0], met[1]) == (83, 85)  # the period before the asked one's, and what is known after it
