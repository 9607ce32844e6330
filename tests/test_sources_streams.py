import datetime as dt
import json

from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import flow, quota
from gleaner.rules import seed_rules, seed_sources
from gleaner.sources import atom, messages, sinks
from gleaner.streaming import ingest

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><id>t1</id><title>[Hiring] A &amp;amp; B</title><category term="alpha" label="x"/><link href="https://example.test/1"/>
<author><name>/u/bob</name></author><published>2024-01-01T10:00:00+00:00</published>
<content type="html">&lt;!-- SC_OFF --&gt;&lt;p&gt;x &amp;amp;amp; y&lt;/p&gt;&lt;!-- SC_ON --&gt; footer</content></entry>
<entry><id>t2</id><title>Link only</title><category term="beta"/><link href="https://example.test/2"/>
<author><name>solo</name></author><published>later</published><content type="html">&lt;a&gt;link&lt;/a&gt;</content></entry>
<entry><title>No id</title></entry>
<entry><id>t4</id></entry>
<entry><id>t5</id><title>Bare</title></entry></feed>"""


def test_atom(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "feed.xml").write_text(FEED)
    got = {r.item_id: r for r in atom.read_atom(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"t1", "t2", "t5"}
    a, b, c = got["t1"], got["t2"], got["t5"]
    assert (a.title, a.tag, a.source, a.author_handle) == ("[Hiring] A & B", "hiring", "alpha", "bob")
    assert (a.body, a.has_body, a.posted_at) == ("x & y", True, dt.datetime(2024, 1, 1, 10))
    assert (b.body, b.has_body, b.author_handle, b.posted_at) == ("", False, "solo", None)
    assert (c.source, c.author_handle, c.permalink) == (None, None, None)


def test_atom_stream_drops_seen_ids(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.xml", "b.xml"):
        (tmp_path / "in" / name).write_text(FEED.replace("later", "2024-01-01T11:00:00Z"))
    stream = ingest.edge(atom.read_atom_stream(spark, str(tmp_path / "in"), 1))
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t1", "t2", "t5"]


def test_messages(spark):
    good = {"item_id": "1", "source": "s", "title": "[Task] x", "body": None, "posted_at": "2024-01-01T10:00:00+00:00"}
    lines = [json.dumps(good), "{oops", json.dumps({**good, "source": ""}), json.dumps({**good, "posted_at": "?"})]
    parsed = messages.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.problem for r in parsed.collect()] == [None, "not_json", "no_source", "bad_posted_at"]
    (row,) = messages.good_items(parsed).collect()
    assert (row.tag, row.body, row.has_body, row.posted_at) == ("task", "", False, dt.datetime(2024, 1, 1, 10))
    assert messages.bad_messages(parsed).count() == 3


def _message(i, text, minute):
    return json.dumps(
        {"item_id": f"i{i}", "source": "source-01", "title": text, "body": "b", "has_body": True,
         "author_handle": "bob", "permalink": "u", "posted_at": f"2024-01-01T10:{minute:02d}:00"}
    )


def test_stream_equals_batch(spark, tmp_path):
    wanted = "need a developer to build a python scraper for my website, budget is $500"
    batches = [
        [_message(1, wanted, 1), _message(2, "nothing of interest in this one, only plain words here", 2)],
        [_message(3, wanted, 3), "{broken"],
        [_message(4, "nothing of interest in this one, only plain words here", 0), _message(5, wanted + " extra words at the end " * 9, 5)],
    ]
    rules = seed_rules()
    tables = ingest.Tables(
        rules=lambda: rules, sources=lambda: seed_sources(spark),
        authors=lambda: spark.createDataFrame([], schemas.AUTHORS),
    )
    store = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    for n, lines in enumerate(batches):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines))
        ingest.run_messages(
            messages.read_message_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "check"), tables,
            classifier_on=False,
        ).awaitTermination()
    raw = ingest.read_raw_items(spark, store)
    # Item 4 was posted first but came in last, so it is the copy and item 2 the original.
    by_id = {r.item_id: r for r in raw.collect()}
    names = {r.id: r.item_id for r in by_id.values()}
    got = {k: (r.reject_rule, names.get(r.duplicate_of)) for k, r in by_id.items()}
    assert got == {
        "i1": (None, None), "i2": ("HF-2_no_signal", None), "i3": ("duplicate", "i1"),
        "i4": ("duplicate", "i2"), "i5": (None, None),
    }
    assert ingest.read_store(spark, store, "quarantine").count() == 1
    lines = [x for batch in batches for x in batch]
    whole = messages.good_items(messages.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")))
    numbered = whole.withColumn("id", F.substring("item_id", 2, 9).cast("bigint")).withColumn("ts", F.timestamp_seconds("id"))
    batch = flow.process(numbered, seed_sources(spark), tables.authors(), rules, F.current_timestamp(), classifier_on=False)
    expected = {r.item_id: (r.reject_rule, f"i{r.duplicate_of}" if r.duplicate_of else None) for r in batch.raw_items.collect()}
    assert got == expected
    scores = {names[r.raw_item_id]: r.score for r in ingest.read_store(spark, store, "matches").collect()}
    assert scores == {f"i{r.raw_item_id}": r.score for r in batch.matches.collect()}
    # Running a batch again leaves the same rows.
    again = messages.good_items(messages.parse_messages(spark.createDataFrame([(x,) for x in batches[2]], "value string")))
    ingest.store_batch(ingest.with_ids(again, 2), 2, store, tables, classifier_on=False)
    repeated = {r.item_id: r.reject_rule for r in ingest.read_raw_items(spark, store).collect()}
    assert repeated == {k: v[0] for k, v in got.items()}
    updates = ingest.duplicate_updates(ingest.read_store(spark, store, "duplicates"))
    assert sorted(names[r.raw_item_id] for r in updates.collect()) == ["i1", "i2"]


def test_call_windows_and_pause(spark, tmp_path):
    calls = spark.createDataFrame(
        [("main", "2024-01-01 10:00:01"), ("main", "2024-01-01 10:00:59"), ("browse", "2024-01-01 10:01:00")],
        "circuit string, at string",
    ).withColumn("ts", F.to_timestamp("at"))
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    query = (
        ingest.call_windows(stream).writeStream.format("memory").queryName("calls_per_minute")
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted((r.circuit, r.calls) for r in spark.table("calls_per_minute").collect()) == [("browse", 1), ("main", 2)]
    matches = spark.createDataFrame([(1, "new"), (2, "suppressed")], "id bigint, status string")
    on = spark.createDataFrame([("paused", "1")], "key string, value string")
    assert ingest.to_deliver(matches, on).count() == 0
    assert [r.id for r in ingest.to_deliver(matches, on.filter("false")).collect()] == [1]
    day = spark.range(1).select(
        ingest.digest_day(F.to_timestamp(F.lit("2024-01-01 23:30:00"))).alias("late"),
        ingest.digest_day(F.to_timestamp(F.lit("2024-01-02 07:59:00"))).alias("early"),
    ).first()
    assert day.late == day.early == dt.date(2024, 1, 2)


def test_quota_minute_before_day(spark):
    start = dt.datetime(2024, 1, 1, 10)
    calls = spark.createDataFrame(
        [(i, "main", start + dt.timedelta(seconds=20 * i)) for i in range(9)], "id bigint, circuit string, ts timestamp"
    )
    got = {r.id: r.admission for r in quota.admit_calls(calls, 2, 5).collect()}
    assert got == {0: "ok", 1: "ok", 2: "minute_limit", 3: "ok", 4: "ok", 5: "minute_limit", 6: "ok", 7: "day_limit", 8: "minute_limit"}


def test_exports(spark, tmp_path):
    usage = spark.createDataFrame(
        [(1, "translate", None, None, "ok", 1, 2, 3, None, None)], schemas.USAGE_LOG
    )
    sinks.write_usage(usage, str(tmp_path / "usage"), 0, "model-x")
    row = spark.read.parquet(str(tmp_path / "usage")).first()
    assert (row.circuit, row.model) == ("main", "model-x")
    assert json.loads(sinks.as_json(usage.select("match_id", "mode")).first().value) == {"match_id": 1, "mode": "translate"}
    sinks.export_json(usage.select("match_id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().match_id == 1


def test_items_without_a_time_are_kept_aside(spark, tmp_path):
    columns = [c.split(" ")[0] for c in schemas.FEED_ITEMS.split(", ")]
    rows = [
        (f"i{n}", "source-01", "need a developer to build a python scraper", "b", True, None, "bob", "u", at)
        for n, at in enumerate([None, dt.datetime(2024, 1, 1, 10), None])
    ]
    tables = ingest.Tables(
        rules=seed_rules, sources=lambda: seed_sources(spark),
        authors=lambda: spark.createDataFrame([], schemas.AUTHORS),
    )
    assert len(columns) == 9
    store = str(tmp_path / "store")
    for number, part in enumerate([rows[:1], rows[1:]]):  # a batch without any time, then a mixed one
        batch = spark.createDataFrame(part, schemas.FEED_ITEMS)
        ingest.store_batch(ingest.with_ids(batch, number), number, store, tables, classifier_on=False)
    untimed = ingest.read_store(spark, store, "untimed")
    assert sorted((r.item_id, r.problem) for r in untimed.collect()) == [("i0", "no_posted_at"), ("i2", "no_posted_at")]
    assert [r.item_id for r in ingest.read_raw_items(spark, store).collect()] == ["i1"]


def test_only_a_missing_table_is_empty(spark, tmp_path):
    import pytest

    assert sinks.read_table(spark, str(tmp_path / "none"), "id BIGINT").count() == 0
    (tmp_path / "broken" / "batch_id=0").mkdir(parents=True)
    (tmp_path / "broken" / "batch_id=0" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="parquet"):
        sinks.read_table(spark, str(tmp_path / "broken"), "id BIGINT").count()


def test_quiet_hours_go_by_the_moment_of_the_decision(spark):
    feed = spark.createDataFrame(
        [(1, "i1", "source-01", "[Hiring] need a developer to build a python scraper, budget is $500", "b", True, "hiring", "bob", "u")],
        "id bigint, item_id string, source string, title string, body string, has_body boolean, tag string, "
        "author_handle string, permalink string",
    ).withColumns({c: F.to_timestamp(F.lit("2024-01-01 22:55:00")) for c in ("ts", "posted_at")})
    authors = spark.createDataFrame([], schemas.AUTHORS)
    rules = seed_rules()

    def status(moment, zone="UTC"):
        now = F.to_timestamp(F.lit(moment))
        result = flow.process(feed, seed_sources(spark), authors, rules, now, classifier_on=False, zone=zone)
        row = result.matches.withColumn("score", F.least("score", F.lit(14))).first()
        wanted = set(c.split(" ")[0] for c in schemas.MATCHES.replace("MAP<STRING, INT>", "MAP").replace(schemas.VERDICT, "S").split(", "))
        assert wanted <= set(result.matches.columns)
        return row.status

    by_day, by_night = status("2024-01-01 22:56:00"), status("2024-01-01 23:10:00")
    assert by_day == status("2024-01-01 23:10:00", "America/New_York")
    assert by_night in ("digest_pending", by_day)
