"""Alignment of two tokenizers against a plain version on the libraries themselves."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from conftest import DATA
from gleaner.llm import align, bpe, queries

SCHEMA = "doc_id bigint, text string, n_a string, chunk string, pair int"
TEXTS = [
    "Plain words, and some more words.",
    "Plain words, and some more words.",
    None,
    "",
    " ",
    "  lead, trail  ",
    "tabs\tand\nlines\r\n\n",
    "<|endoftext|> </s><s><unk> <0x41> [INST]",
    "a ▁ blank of the other kind",
    "Übergröße, naïve façade — “quoted” … 한국어 日本語 \U0001f600\U0001f468‍\U0001f469",
    "12345678901234567890 3.14159 1,000,000",
    "a" * 3000 + "b" * 501,
    "=" * 777 + "-" * 1001 + "\x00\x01\x7f",
    " " * 5000 + "end",
    " ".join(f"word{i % 977} and" for i in range(20_000)),
]


@pytest.fixture(scope="module")
def definitions(spark):
    return [bpe.load_definition(spark, tokenizer_path(n)) for n in (queries.TOKENIZER, queries.PIECES)]


@pytest.fixture(scope="module")
def sides():
    """Functions that give the ids of a text and the bytes of an id."""
    library = Tokenizer.from_file(tokenizer_path(queries.TOKENIZER))
    library.encode_special_tokens = True
    with open(tokenizer_path(queries.TOKENIZER)) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    value = {letter: byte for byte, letter in enumerate(bpe.byte_letters())}
    strings = {i: bytes(value.get(c, 0) for c in text) for text, i in vocabulary.items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(queries.PIECES))

    def piece(i):
        name = pieces.id_to_piece(i)
        if len(name) == 6 and name.startswith("<0x"):
            return bytes.fromhex(name[3:5])
        return name.replace("▁", " ").encode()

    return (
        lambda text: [(i, strings[i]) for i in library.encode(" " + text, add_special_tokens=False).ids],
        lambda text: [(i, piece(i)) for i in pieces.encode(text)],
    )


def brute(texts, sides):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    links, heads = [], []
    for text in texts:
        a, b = ([], []) if not text else [side(text) for side in sides]
        whole = b" " + (text or "").encode()
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            a = b = []
        ends = [[sum(len(x) for _, x in side[: n + 1]) for n in range(len(side))] for side in (a, b)] if len(a) < 400 else [
            np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)
        ]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and ends[0][i] <= cut:
                left.append(a[i][0])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                right.append(b[j][0])
                j += 1
            groups.append((left, right))
        links.append(Counter((x, y) for left, right in groups for x in left for y in right))
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        heads.append((len(a), len(b), len(groups), sum(links[-1].values()), digest))
    count = Counter(pair for found in links for pair in found)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [
        (*head[:4], sum(m for p, m in found.items() if count[p] == highest[p[0]]),
         sum(m * count[p] for p, m in found.items()), head[4])
        for head, found in zip(heads, links, strict=True)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [4_000_000, 40])
def test_alignment(spark, definitions, sides, size, monkeypatch):
    monkeypatch.setattr(align, "SLICE_BYTES", size)
    rows = [(n if n % 5 else None, text, "x", "y", 1) for n, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = align.align(docs, *definitions).collect()
    wanted = brute(TEXTS, sides)
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted(
        (str(row[0]), *numbers) for row, numbers in zip(rows, wanted, strict=True)
    )
    assert [c for c in got[0].asDict() if c != "doc_id"] == COLUMNS


def test_alignment_of_nothing_and_of_texts_without_tokens(spark, definitions):
    docs = spark.createDataFrame([(1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, "▁", "x", "y", 1)], SCHEMA)
    rows = align.align(docs, *definitions).collect()
    assert sorted(tuple(r) for r in rows) == [(n, 0, 0, 0, 0, 0, 0, "") for n in (1, 2, 3)]
    assert align.align(docs.where("false"), *definitions).count() == 0
    with pytest.raises(ValueError):
        align.align(docs, *definitions, keep=["doc_id", "n_a"])


def test_lockstep_equals_a_walk_for_each_document():
    random = np.random.default_rng(5)
    docs = []
    for _ in range(60):
        size = int(random.integers(1, 300))
        docs.append([np.union1d(random.integers(1, size + 1, random.integers(1, 60)), [size]) for _ in "ab"])
    lengths = [np.array([len(d[side]) for d in docs]) for side in (0, 1)]
    base = np.cumsum([0, *(d[0][-1] for d in docs)])[:-1]
    ends = [np.concatenate([d[side] + at for d, at in zip(docs, base, strict=True)]) for side in (0, 1)]
    upto = [np.cumsum(n) for n in lengths]
    got = align.lockstep(ends[0], ends[1], upto[0] - lengths[0], upto[0], upto[1] - lengths[1])
    wanted, i, j = [], 0, 0
    start = (0, 0)
    while i < len(ends[0]):
        if ends[0][i] == ends[1][j]:
            i, j = i + 1, j + 1
            wanted.append((start[0], i, start[1], j))
            start = (i, j)
        elif ends[0][i] < ends[1][j]:
            i += 1
        else:
            j += 1
    assert list(zip(*(g.tolist() for g in got), strict=True)) == wanted


def test_wide_groups_count_like_narrow_ones(monkeypatch):
    ids_a, ids_b = np.arange(40) % 7, np.arange(30) % 4
    groups = tuple(np.array(x) for x in ([0, 3], [3, 40], [0, 1], [1, 30]))
    owner = np.array([0, 0])

    def counted():
        found = Counter()
        for document, pair, n in zip(*align.linked_pairs(ids_a, ids_b, groups, owner), strict=True):
            found[int(document), int(pair)] += int(n)
        return found

    narrow = counted()
    monkeypatch.setattr(align, "WIDE_GROUP", 1)
    assert counted() == narrow and sum(narrow.values()) == 3 + 37 * 29


def test_registered_query_equals_plain_version(spark, sides):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    wanted = brute([r["text"] for r in texts], sides)
    got = queries.QUERIES["op11_alignment"](spark, DATA).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == sorted(
        (r["doc_id"], *numbers) for r, numbers in zip(texts, wanted, strict=True)
    )
