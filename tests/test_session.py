import os

from pyspark.sql import functions as F

from gleaner import session


def test_scratch_deletes_what_was_written_inside(spark):
    kept = session.cut_lineage(spark.range(5))
    with session.scratch(spark):
        inside = session.cut_lineage(spark.range(7))
        assert inside.count() == 7
        path = session._written.get()[-1]
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert kept.count() == 5


def test_scratch_leaves_tables_of_other_threads(spark):
    import threading

    entered, left, counts = threading.Event(), threading.Event(), []

    def other():
        with session.scratch(spark):
            table = session.cut_lineage(spark.range(9))
            entered.set()
            left.wait(60)
            counts.append(table.count())

    thread = threading.Thread(target=other)
    with session.scratch(spark):
        thread.start()
        assert entered.wait(60)
        session.cut_lineage(spark.range(3))
    left.set()
    thread.join()
    assert counts == [9]


def test_broadcast_only_below_the_bound(spark):
    table = spark.range(100).select("id", F.lit("x" * 50).alias("name"))
    big = spark.range(1000)

    def plan(bound):
        joined = big.join(session.broadcast_if_small(table, bound), "id")
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(1 << 20)
    assert "strategy=broadcast" not in plan(100)


def test_keys_of_a_large_table_are_not_broadcast(spark):
    rows = spark.range(2_000).select((F.col("id") % 700).alias("k"), "id").withColumn("k", F.when(F.col("k") > 5, F.col("k")))
    asked = spark.range(0, 600, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    asked = asked.unionByName(asked)

    def run(bound):
        found = session.with_keys_of(rows, asked, ["k"], bound)
        return found, sorted(tuple(r) for r in found.collect())

    wanted = sorted((i % 700, i) for i in range(2_000) if i % 700 > 5 and i % 700 % 3 == 0 and i % 700 < 600)
    few, by_broadcast = run(1 << 20)
    many, by_shuffle = run(100)
    assert by_broadcast == by_shuffle == wanted
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()  # stored, no longer laid out by key
    # The files of 100,000 hashes would pass as small; what a broadcast of them takes does not.
    keys = spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    kept = session.with_keys_of(keys.withColumn("id", F.lit(1)), keys, ["k"])
    assert "strategy=broadcast" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 100_000
