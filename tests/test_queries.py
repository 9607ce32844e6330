"""Each registered query against its DuckDB text."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from conftest import DATA

TEXTS = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    query = queries()[name]
    if name in TEXTS:
        assert differences(spark, db, query, TEXTS[name], DATA) == []
    else:
        assert query(spark, DATA).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 1


def test_signals_add_up(spark):
    from pyspark.sql import functions as F

    points = queries()["signals_explode"](spark, DATA).groupBy("id").agg(F.sum("points").alias("sum"))
    scores = queries()["score_total"](spark, DATA)
    assert scores.join(points, "id", "left").filter("score <> coalesce(sum, 0)").count() == 0


def test_all_branches_occur(spark):
    """The judged branches fire on the test data, so equal results mean something."""
    from pyspark.sql import functions as F

    folder = DATA.replace("0.001", "0.01")

    def rows(name, condition):
        return queries()[name](spark, folder).where(condition).count()

    for condition in ("bullet_line_count > 0", "has_links", "title_is_question", "NOT has_body"):
        assert rows("struct_features", condition) > 0, condition
    assert rows("section_headers", "found") > 0 and rows("section_headers", "NOT found") > 0
    assert rows("compensation_extract", "compensation IS NOT NULL") > 0
    for tag in ("hiring", "task", "for hire"):
        assert rows("extract_tag", F.col("tag") == tag) > 0
    from gleaner.plans import corpus

    feed = corpus.feed_items(spark, folder)
    copies = feed.groupBy(F.md5(F.concat("title", "body"))).agg(
        F.count("*").alias("n"), (F.max("posted_at") - F.min("posted_at")).alias("span")
    )
    assert copies.where("n > 1 AND span > INTERVAL 30 DAYS").count() > 0
    assert copies.where("n > 1 AND span < INTERVAL 14 DAYS").count() > 0
    for points in (-5, 0, 2):
        assert rows("author_bonus", F.col("author_bonus") == points) > 0, points
    assert rows("hf_chain", "reject_rule = 'HF-4_low_info'") > 0
    for outcome in ("stored", "late", "repeated"):
        assert rows("edge_stream", F.col("outcome") == outcome) > 0, outcome
    assert rows("send_times", "sent_at > ts") > 0 and rows("send_times", "sent_at = ts") > 0
