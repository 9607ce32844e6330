import datetime as dt
import random

from hypothesis import HealthCheck, given, settings, strategies as st
import pytest

from gleaner.operators import dedup
from gleaner.operators.ordered import carry_last
from gleaner.session import cut_lineage
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, text_hash string, simhash bigint"


def signed(value):
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >= 1 << 63 else value


def near_by_force(rows, days=14):
    found = {}
    for i, ts, _, h in rows:
        before = [
            (bin((h ^ g) & ((1 << 64) - 1)).count("1"), at, j)
            for j, at, _, g in rows
            if (at, j) < (ts, i) and at >= ts - dt.timedelta(days=days)
        ]
        close = sorted((d > 0, at, j) for d, at, j in before if d <= 3)
        if close:
            found[i] = close[0][2]
    return found


def exact_by_force(rows, days=30):
    found = {}
    for i, ts, h, _ in rows:
        before = sorted(
            (at, j) for j, at, g, _ in rows
            if g == h and (at, j) < (ts, i) and at >= ts - dt.timedelta(days=days)
        )
        if before:
            found[i] = before[0][1]
    return found


def sample(seed, n=160):
    """Items over 80 days: few texts, clusters of near hashes, equal times, one very hot hash."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(n):
        h = rng.choice(centres)
        for bit in rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 4])):
            h ^= 1 << bit
        if i % 3 == 0:
            h = 0
        ts = T0 + dt.timedelta(minutes=rng.choice([0, 5, 20000, 20160, 43200, 115000]) + rng.randrange(60))
        rows.append((i, ts, f"text{rng.randrange(12) if i % 3 else 0}", signed(h)))
    return rows


def as_dict(df):
    return {r[0]: r[1] for r in df.select("id", "original").collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowded", [1, 4, 256])
def test_near_equals_brute_force(spark, seed, crowded):
    rows = sample(seed)
    items = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(dedup.near_originals(items, crowded=crowded)) == near_by_force(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_equals_brute_force(spark, seed):
    rows = sample(seed)
    items = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(dedup.exact_originals(items)) == exact_by_force(rows)


def test_asked_subset_gives_the_same_answers(spark):
    rows = sample(5)
    items = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([r for r in rows if r[0] % 2], SCHEMA)
    odd = {i: o for i, o in near_by_force(rows).items() if i % 2}
    assert as_dict(dedup.near_originals(items, asked=asked)) == odd
    odd = {i: o for i, o in exact_by_force(rows).items() if i % 2}
    assert as_dict(dedup.exact_originals(items, asked=asked)) == odd


def test_lookback_examples(spark):
    day = dt.timedelta(days=1)
    a = 0b1011 << 40
    rows = [
        (1, T0, "x", a),
        (2, T0 + 13 * day, "y", a ^ 0b111),
        (3, T0 + 13 * day, "z", a ^ (0b1111 << 50)),
        (4, T0 + 28 * day, "w", a ^ (1 << 60)),
        (5, T0 + 29 * day, "x", signed(a << 1)),
        (6, T0 + 31 * day, "x", signed(~a)),
    ]
    items = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(dedup.exact_originals(items)) == {5: 1, 6: 5}
    near = as_dict(dedup.near_originals(items))
    assert near[2] == 1 and 3 not in near and 4 not in near


def test_twenty_triples_cover_all_near_pairs():
    masks = [m & ((1 << 64) - 1) for m in dedup._triple_masks()]
    assert len(masks) == 20
    rng = random.Random(7)
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(m & difference == 0 for m in masks)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=30))
def test_carry_last_equals_a_loop(spark, events):
    rows = [(k, T0 + dt.timedelta(minutes=m), i, v) for i, (k, m, v) in enumerate(events)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i bigint, v int")
    got = {r.i: r.before for r in carry_last(df, ["k"], "ts", "i", {"before": F.col("v")}, 300).collect()}
    expected, last = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == expected


def test_counts_and_marks(spark):
    found = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "id bigint, duplicate_of bigint")
    matches = spark.createDataFrame([(10, 1), (11, 9)], "id bigint, raw_item_id bigint")
    assert [tuple(r) for r in dedup.duplicate_counts(found, matches).collect()] == [(10, 1, 2)]
    items = spark.createDataFrame([(1, None), (2, "HF-1_length")], "id bigint, reject_rule string")
    assert {r.id: r.reject_rule for r in dedup.mark_duplicates(items, found).collect()} == {1: None, 2: "duplicate"}


def test_exploded_keys_are_not_broadcast(spark):
    """Their tables are a few kilobytes here, twenty and 2,081 times as much once exploded."""
    rows = spark.range(200).select("id", F.timestamp_seconds("id").alias("ts"), F.xxhash64("id").alias("simhash"))
    items = cut_lineage(rows)
    period = dedup.period_of(F.col("ts"), 14).alias("period")
    probes = cut_lineage(items.select("id", "ts", "simhash", F.col("ts").alias("at"), period))
    spans = cut_lineage(dedup.near_keys(items).select("simhash", "period", "first", "last").distinct())
    in_keys = dedup._near_in_keys(dedup._triple_keys(probes, "simhash"), dedup.near_keys(items))
    in_crowds = dedup._near_in_crowds(probes.drop("period"), spans)
    for met in (in_keys, in_crowds):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
