"""Chat formatting, vector search and the pipeline against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DATA
from gleaner.llm import chat, kdtree, langid, queries, toxicity
from test_llm_documents import ROWS, SCHEMA, brute_classes, check_packing

TURNS = [
    (1, 0, "system", "be <|kind|> \\ and \\\\"),
    (1, 1, "user", "say [INST] </s> <s>"),
    (1, 2, "assistant", "<\\s> <\\|turn|> done <|end|>\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "trailing"),
    (2, None, None, "no role"),
    (2, 1, "assistant", "one"),
    (2, 1, "assistant", "one"),
    (None, 0, "assistant", "no id"),
    (3, 0, "us<|text|>er", "odd role"),
    (4, 0, "assistant", "x" * 200_000 + "<|end|>"),
]


def test_chat_reads_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumns({c: F.lit(1) for c in ("target", "block", "formatted", "head", "chars")})
    formatted = chat.format_conversations(turns)
    got = {
        r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]]
        for r in formatted.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()
    }
    wanted = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0)):
        wanted[conv].append((role or "", text or ""))
    assert got == dict(wanted)
    examples = chat.example_texts(chat.expand(formatted)).collect()
    by_conv = defaultdict(list)
    for r in sorted(examples, key=lambda r: r["target"]):
        by_conv[r["conv_id"]].append(r)
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    for conv, rows in by_conv.items():
        assert all(whole[conv].startswith(r["text"]) for r in rows) and rows[-1]["text"] == whole[conv]
        replies = [t for role, t in wanted[conv] if role == "assistant"]
        masked = [r["text"][r["loss_start"] :][: r["loss_chars"]] for r in rows if r["loss_chars"] is not None]
        assert len(masked) == len(replies)
        for r in rows:
            assert "<|" not in r["text"][r["loss_start"] :][: r["loss_chars"] or 0]
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_examples_have_texts_and_masks_of_their_own(spark, monkeypatch):
    rows = [(1, n, "assistant" if n % 2 else "user", f"<s>{n}" * (n + 1)) for n in range(7)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.expand(chat.format_conversations(turns))
    read = examples.select(
        "target", "chars", "text", chat.parse(F.col("text")).alias("turns"), chat.trainable_text().alias("loss")
    )
    found = sorted(read.collect())
    assert [r["target"] for r in found] == [2, 4, 6, 7]
    for r in found:
        assert len(r["text"]) == r["chars"]
        assert [tuple(t) for t in r["turns"]] == [row[2:] for row in rows[: r["target"]]]
        assert r["loss"] == (rows[r["target"] - 1][3] if r["target"] % 2 == 0 else None)
    # What the query gives is read from the examples' texts, each from its own.
    whole, expand = queries.op2_chat(spark, DATA).where("conv_id = -1").first(), chat.expand

    def damaged(formatted):
        return expand(formatted).withColumn("text", F.regexp_replace("text", "ok", "no"))

    monkeypatch.setattr(chat, "expand", damaged)
    other = queries.op2_chat(spark, DATA).where("conv_id = -1").first()
    assert whole["turns_sha256"] != other["turns_sha256"] and whole["loss_sha256"] != other["loss_sha256"]


def test_chat_escape_is_reversible(spark):
    import random

    chance = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "/", "s>", "INST]", "x", "\n", "<\\", "[\\/"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randrange(12))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")
    )
    for r in rows.collect():
        assert r["t"] == r["back"] and not any(c in r["e"] for c in chat.CONTROL)


def brute_top(vectors, k=20):
    used = [(i, v) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    ints = np.floor(64 * np.array([v for _, v in used], np.float64)).astype(np.int64)
    out = []
    for q, (query, _) in enumerate(used):
        if query is not None and query % 20 == 0:
            scores = ints @ ints[q]
            others = [(-int(s), 2**63 if i is None else i) for j, ((i, _), s) in enumerate(zip(used, scores, strict=True)) if j != q]
            out += [(query, rank, i if i < 2**63 else None, -s) for rank, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(2048, 256), (64, 16), (7, 3)])
def test_top_k(spark, shard_rows, block_rows):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.standard_normal(6).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, [0.5, -0.25, 0.0, 1.0, 0.125, 0.75]) for i in range(150)]  # equal vectors
    rows += [(20, rows[20][1]), (40, rows[40][1]), (None, rows[5][1]), (560, None), (580, []), (600, [None] * 6), (620, [float("nan")] * 6), (640, [float("inf")] * 6)]
    short = [(700, [1.0, 2.0]), (701, [3.0, -1.0]), (720, [0.5, 0.5])]
    table = spark.createDataFrame(rows + short, "vec_id bigint, embedding array<float>")
    table = table.withColumns({c: F.lit("x") for c in ("row", "score", "ints", "shard", "rank")})
    from gleaner.session import cut_lineage

    vectors = cut_lineage(kdtree.quantised(table))
    found = kdtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, shard_rows, block_rows).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_top(rows) + brute_top(short), key=str)
    none = kdtree.quantised(table.where("false"))
    assert kdtree.top_k(none, none).count() == 0


@pytest.mark.parametrize(("shards", "blocks"), [(1, 1), (1, 5), (7, 3), (3, 8), (40, 6)])
def test_each_block_meets_each_shard_once_and_alone(spark, shards, blocks):
    vectors = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    asked = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    pairs = []
    for low, high in kdtree.rounds(shards):
        left = kdtree.met(vectors, "block", blocks, shards, low, high).select("shard", "block").collect()
        right = kdtree.met(asked, "shard", shards, shards, low, high).select("shard", "block").collect()
        assert sorted(left) == sorted(right)
        pairs += map(tuple, left)
    assert sorted(pairs) == [(s, b) for s in range(shards) for b in range(blocks)]


def test_tree_visits_few_boxes_of_clustered_points():
    random = np.random.default_rng(5)
    centres = random.standard_normal((40, 8)) * 100
    points = np.floor(centres[random.integers(0, 40, 4_000)] + random.standard_normal((4_000, 8)))
    tree = kdtree.Tree(points, 32)
    assert sorted(tree.order) == list(range(4_000))
    bounds = tree.bounds(points[:5])
    for number, (begin, end) in enumerate(tree.span):
        assert (tree.points[begin:end] @ points[:5].T <= bounds[:, number] + 1e-6).all()


def test_pipeline(spark):
    """Each stage against a plain version on all that its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from gleaner.session import cut_lineage

    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    library = Tokenizer.from_file(tokenizer_path(queries.TOKENIZER))
    for name in ("language", "toxicity", "exact_dedup", "near_dedup"):
        net = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), ~queries.held_out(5, 0))
        docs = cut_lineage(stages[name](spark, docs, DATA))
        assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            kept = {i: t for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "toxicity":
            scores = toxicity.Scorer(net).logits(list(kept.values()))
            kept = {i: t for (i, t), s in zip(kept.items(), scores, strict=True) if s < 0}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in kept.items():
                groups["".join(t.split())].append((-len(t), i))
            stay = {min(g)[1] for g in groups.values()}
            kept = {i: t for i, t in kept.items() if i in stay}
        else:
            roots = brute_classes(list(kept.items()))
            first = {}
            for (i, _), r in zip(kept.items(), roots, strict=True):
                first[r] = min(i, first.get(r, i))
            kept = {i: t for i, t in kept.items() if i in first.values()}
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
    pieces = stages["packing"](spark, docs, DATA).collect()
    assert check_packing(pieces, kept.items(), library) > 0.9


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "kept", "row", "digest")})
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, DATA)
            if docs is not odd:
                assert result.count() == 0
            elif name == "packing":  # every row has a piece that starts it
                assert result.where("start = 0").count() == len(ROWS)
            else:
                assert result.columns == corpus_pipeline.COLUMNS and 0 < result.count() <= len(ROWS)


def test_query_digests(spark):
    rows = queries.op2_chat(spark, DATA).where("conv_id = -1").collect()
    hostile = queries.CONTROL_CONVERSATION
    assert len(rows) == 1 and rows[0]["n_turns"] == 2 and rows[0]["loss_chars"] == len(hostile)
    assert rows[0]["loss_sha256"] == hashlib.sha256(hostile.encode()).hexdigest()
    assert langid.UNKNOWN == "und"


@pytest.mark.parametrize("size", [1e5, 1e6, 3e6])
def test_top_k_is_exact_with_large_components(spark, size):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (size * random.standard_normal(8)).round()]) for i in range(300)]
    vectors = kdtree.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    from gleaner.session import cut_lineage

    vectors = cut_lineage(vectors)
    assert kdtree.exact_type(vectors) is (np.float64 if size < 1e6 else np.int64)
    found = kdtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 64, 8).collect()
    assert sorted(map(tuple, found), key=str) == brute_top(rows)


@pytest.mark.parametrize("size", [1e8, 1e30])
def test_top_k_refuses_products_that_do_not_fit(spark, size):
    rows = [(i, [size * (i + 1)] * 8) for i in range(5)]
    vectors = kdtree.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    with pytest.raises(Exception, match="do not fit|OVERFLOW|overflow"):
        kdtree.top_k(vectors, vectors).collect()
