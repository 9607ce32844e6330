"""The k-means tree against brute force."""

import math

import numpy as np
import pytest

from gleaner.llm import kmeanstree, queries
from conftest import DATA

SCHEMA = "vec_id bigint, embedding array<float>, row int, leaf string"


def brute(rows, k, asked):
    """{row number of a query: [(identifier, distance)]}; rows are (identifier, vector)."""
    sound = []
    for number, (vec_id, vector) in enumerate(rows):
        if vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            sound.append((number, vec_id, np.array(vector, np.float32).astype(float)))
    found = {}
    for number, vec_id, vector in sound:
        if vec_id is None or not asked(vec_id):
            continue
        others = [
            (math.sqrt(((other - vector) ** 2).sum()), other_id is None, other_id or 0, other_id)
            for n, other_id, other in sound
            if n != number and len(other) == len(vector)
        ]
        found[number] = [(o[3], o[0]) for o in sorted(others, key=lambda o: o[:3])[:k]]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def clustered(random, n, size=8, centres=20):
    middle = random.normal(size=(centres, size))
    return [(i, (middle[i % centres] + 0.2 * random.normal(size=size)).tolist()) for i in range(n)]


def recall(got, wanted, rows):
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for number, best in wanted.items():
        mine = sorted(by_query.get(rows[number][0], []))
        assert [rank for rank, _, _ in mine] == list(range(1, len(best) + 1))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        total += len(best)
        hits += sum(score <= best[-1][1] for _, _, score in mine)
    return hits / max(total, 1)


@pytest.mark.parametrize("leaf_rows", [16, 64])
def test_recall_is_reached(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(kmeanstree, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(kmeanstree, "ROW_BLOCK", 20)
    monkeypatch.setattr(kmeanstree, "QUERY_BLOCK", 3)
    rows = clustered(np.random.default_rng(2), 1500)
    got = kmeanstree.nearest_neighbours(table(spark, rows).repartition(4), "id % 20 = 0", k=10).collect()
    assert recall(got, brute(rows, 10, lambda i: i % 20 == 0), rows) >= 0.9


def test_all_leaves_give_exact_results(spark):
    """Odd rows, copies and ties; with a recall of one the search is exact."""
    random = np.random.default_rng(3)
    rows = clustered(random, 120)
    rows += [(200 + n, rows[0][1]) for n in range(30)]  # copies of a query
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[7][1]), (None, None), (40, None)]
    rows += [(60, [0.0] * 8), (80, [float("nan")] * 8), (81, [float("inf")] + [0.0] * 7), (82, [None] + [1.0] * 7)]
    rows += [(100, []), (1000, [1.0, 2.0]), (1001, [1.0, 3.0]), (1020, [5.0])]
    rows += [(1040, [3e38] + [0.0] * 7), (1041, [-3e38] + [1.0] * 7)]
    got = kmeanstree.nearest_neighbours(table(spark, rows).repartition(3), "id % 20 = 0", recall=1.0).collect()
    wanted = brute(rows, 10, lambda i: i % 20 == 0)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(i, s) for _, i, s in sorted(v, key=lambda x: x[0])] for q, v in by_query.items()} == {
        rows[n][0]: best for n, best in wanted.items() if best
    }


def test_visits_are_widened_until_the_recall_is_reached(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "LEAF_ROWS", 8)
    rows = kmeanstree.usable(table(spark, clustered(np.random.default_rng(4), 600, centres=60)))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    trees = kmeanstree.fit(rows, 600)
    indexed = kmeanstree.indexed(rows, trees)
    assert indexed.count() == 600 and indexed.select("leaf").distinct().count() > 30
    visits = [kmeanstree.calibrated_visits(indexed, rows, trees, 5, share, 100) for share in (0.3, 0.9, 1.0)]
    assert visits == sorted(visits) and visits[0] < visits[-1] <= len(trees[8].leaf) * 2


def test_tree_walk_is_best_first_and_meets_every_leaf_once():
    random = np.random.default_rng(5)
    tree = kmeanstree.Tree(random.normal(size=(2000, 4)), rows_each=2.0)
    query = random.normal(size=4)
    leaves = list(tree.visits(query))
    assert sorted(leaves) == list(range(len(tree.leaf))) and len(leaves) > 5
    assert set(tree.place(random.normal(size=(500, 4)))) <= set(leaves)
    equal = kmeanstree.Tree(np.ones((5000, 3)), rows_each=1.0)
    assert list(equal.visits(np.ones(3))) == [0]


def test_copies_beyond_the_first_have_no_effect(spark):
    rows = clustered(np.random.default_rng(6), 60) + [(1000 + n, [0.5] * 8) for n in range(400)]
    got = kmeanstree.nearest_neighbours(table(spark, rows), "id % 20 = 0", k=3, recall=1.0).collect()
    wanted = brute(rows, 3, lambda i: i % 20 == 0)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {
        (rows[n][0], rank + 1): best[0] for n, found in wanted.items() for rank, best in enumerate(found)
    }


def test_nothing(spark):
    empty = table(spark, [(1, [1.0])]).where("false")
    assert kmeanstree.nearest_neighbours(empty, "id % 100 = 0").collect() == []
    alone = table(spark, [(100, [1.0])])
    assert kmeanstree.nearest_neighbours(alone, "id % 100 = 0").collect() == []
    assert kmeanstree.nearest_neighbours(table(spark, [(1, [1.0])]), "id % 100 = 0").collect() == []


def test_registered_query(spark):
    got = queries.QUERIES["op12_neighbours"](spark, DATA).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert recall(got, brute(rows, 10, lambda i: i % 100 == 0), rows) >= 0.9
    assert got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
