"""Operators on documents against plain versions: odd rows, empty tables, clashing columns."""

import hashlib
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DATA
from gleaner.llm import (
    bagminhash,
    bpe,
    contentsort,
    graphs,
    langid,
    licenses,
    packing,
    queries,
    ring,
    toxicity,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
ROWS = [
    (1, "The first plain text, with some words in it and a few more.", "en", "a", 1),
    (2, "The first plain text, with some words in it and a few more.", "en", "a", 1),
    (2, "The first plain text, with some words in it and a few more.", "en", "a", 1),
    (3, "The first plain text,\twith some words in it and a few more.\n\n", "en", "a", 1),
    (4, None, "en", "a", None),
    (5, "", None, None, 0),
    (6, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (None, "The first plain text, with some words in it and a few more.", "en", "a", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " end", "en", "b", 1),
    (9, "x" * 50_000, "en", "b", 1),
    (10, "12 34 !! ... \U0001f600", "en", "b", 1),
    (11, "Größe été niño <|endoftext|> ß́   　日本語 ١٢", "de", "b", 1),
    (12, "a", "en", "b", 1),
    (13, "Released under the MIT License. All rights reserved.", "en", "b", 1),
    (14, "idiot " * 3, "en", "b", 1),
    (15, "a b a b a b a b a b a b a b a b a b a b", "en", "b", 1),
    (16, "a b a b a b a b a b a b a b a b a b a b a b", "en", "b", 1),
    (17, "plain nul \x00 and del \x7f", "en", "b", 1),
]
CLASHING = "score lang_pred kept keep_id group_size row key range norm ids n_tokens shard slot size " \
    "sequence_id offset digest total keys draw toxic label _text at arc bucket length start"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns named like the operators' own."""
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit("other") for c in CLASHING.split()})


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(queries.TOKENIZER))


@pytest.fixture(scope="module")
def definition(spark):
    return bpe.load_definition(spark, tokenizer_path(queries.TOKENIZER))


def test_bpe_equals_library(odd, nothing, definition, library):
    encoded = bpe.encode(odd, definition)
    rows = bpe.decode(encoded, definition, ["doc_id", "n_tokens"]).collect()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows)
    wanted = Counter()
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        wanted[doc_id, len(ids), packed, library.decode(ids, skip_special_tokens=False)] += 1
    assert got == wanted
    assert bpe.encode(nothing, definition).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd, definition, keep=["doc_id", "ids"])


def test_bpe_on_random_strings(library):
    import random

    from hypothesis import given, settings
    from hypothesis import strategies as st

    with open(tokenizer_path(queries.TOKENIZER), "rb") as file:
        own = bpe.ByteBPE(file.read())
    compiled = packing.CompiledBPE(own)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
    def check(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own.encode(text)).cast("I")) == ids
        assert compiled.encode(text) == own.encode(text)
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)

    check()
    chance = random.Random(4)
    for _ in range(200):
        ids = [chance.randrange(50_257) for _ in range(12)]
        assert own.decode(struct.pack("<12I", *ids)) == library.decode(ids, skip_special_tokens=False)
    deep = " " * 2_000_000 + "x"
    assert compiled.encode(deep) == own.encode(deep)


def test_bpe_knows_the_letters_of_the_library(library):
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    words = bpe.word_pattern()
    for code in [*range(0x20, 0x3100), *range(0xA000, 0xAC00), *range(0x10000, 0x1F000, 3)]:
        text = f"a{chr(code)}1{chr(code)}!{chr(code)} {chr(code)}  {chr(code)}"
        assert [m.span() for m in words.finditer(text)] == [at for _, at in cut.pre_tokenize_str(text)]


def test_bpe_words_of_common_texts_do_not_pay_for_rare_letters():
    """The classes with all of Unicode took five times as long for the ends of words."""
    with open(tokenizer_path(queries.TOKENIZER), "rb") as file:
        own = bpe.ByteBPE(file.read())
    every = bpe.word_pattern().findall
    for code in range(0x20, 0x10000):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)}!{chr(code)} {chr(code)}  {chr(code)}"
            assert own.words(text) == every(text)
    for text in ("naïve 😀 words\U000105c0 1𝟘!", "\U00010000", "\uffff a\U0010ffff"):
        assert own.words(text) == every(text)
    prose = "Zwölf words, and a few more of it's kind. " * 5000

    def seconds(cut):
        began = time.thread_time()
        cut(prose)
        return time.thread_time() - began

    assert min(seconds(own.words) for _ in range(3)) < 0.6 * min(seconds(every) for _ in range(3))


def check_packing(rows, texts, library):
    """All ids of all texts lie in one place each; returns the share of places that are used."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    wanted = defaultdict(list)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            crc = zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            wanted[doc_id, len(ids)].append((start, len(part), crc))
    assert {k: sorted(v) for k, v in documents.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert set(sequences) == set(range(len(sequences)))
    return sum(length for parts in sequences.values() for _, length in parts) / 1024 / len(sequences)


def test_packing(odd, nothing, definition, library):
    def packed(docs, **options):
        pieces = packing.cut_pieces(docs, definition)
        return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), **options)

    texts = [(r[0], r[1]) for r in ROWS]
    check_packing(packed(odd).collect(), texts, library)
    check_packing(packed(odd, rows_per_bucket=3).collect(), texts, library)
    assert packed(nothing).count() == 0


def test_places_of_lengths():
    import random

    chance = random.Random(7)
    for _ in range(50):
        histogram = {chance.randint(1, 64): chance.randint(1, 300) for _ in range(20)}
        used = defaultdict(list)
        for length, rank, count, first, offset in packing.place_lengths(histogram, 64):
            for i in range(count):
                used[first + i].append((offset, length, rank + i))
        for parts in used.values():
            at = 0
            for offset, length, _ in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        ranks = defaultdict(list)
        for parts in used.values():
            for _, length, rank in parts:
                ranks[length].append(rank)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        least = -(-sum(k * n for k, n in histogram.items()) // 64)
        assert len(used) <= 1.35 * least + 20


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_content_sort(odd, nothing, ranges):
    rows = contentsort.content_groups(odd, ["doc_id", "text"], ranges).collect()
    blank = str.maketrans("", "", contentsort.WHITE_SPACE)
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[(text or "").translate(blank)].append((-len(text or ""), doc_id is None, doc_id or 0))
    assert len(rows) == len(ROWS)
    kept = Counter()
    for r in rows:
        norm = (r["text"] or "").translate(blank)
        _, none, doc_id = min(groups[norm])
        assert r["keep_id"] == (None if none else doc_id)
        assert r["group_size"] == len(groups[norm])
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert contentsort.content_groups(nothing, ranges=ranges).count() == 0


def test_content_sort_with_one_hot_text(spark):
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"),
    )
    rows = contentsort.content_groups(docs, ranges=16).collect()
    hot = [r for r in rows if r["group_size"] == 1_000]
    assert len(hot) == 1_000 and {r["keep_id"] for r in hot} == {0} and sum(r["kept"] for r in hot) == 1
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_ring(odd, nothing, spark):
    for docs, texts in ((odd, [(r[0], r[1]) for r in ROWS]), (spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), [(i, "x") for i in range(1003)])):
        rows = ring.bounded_ring(docs, shards=8).collect()
        wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert ring.bounded_ring(nothing).count() == 0


def test_ring_moves_few_rows(spark):
    """Without a full shard a row goes to the next point; most rows stay there with bounds too."""
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    points = ring.ring_points(spark, 8, ring.VIRTUAL_NODES)
    rows = ring.bounded_ring(docs).collect()
    at = {r["doc_id"]: r["at"] for r in docs.select("doc_id", ring.place(F.col("doc_id"), F.crc32(F.lit("x").cast("binary")), F.lit(2).cast("bigint")).alias("at")).collect()}
    first = [next((s for p, s in points if int(p) >= at[r["doc_id"]]), points[0][1]) for r in rows]
    assert sum(s == r["shard"] for s, r in zip(first, rows, strict=True)) > 0.85 * len(rows)


def brute_classes(rows):
    """Class of each row by comparing all pairs; rows without words stand alone."""
    multisets = [bagminhash.shingles(bagminhash.words_of((t or "").lower())) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(multisets[i][0]) and bagminhash.similarity(multisets[i], multisets[j]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_near_classes(odd, nothing):
    got = bagminhash.near_classes(odd).collect()
    roots = brute_classes([(r[0], r[1]) for r in ROWS])
    members = defaultdict(list)
    for (doc_id, *_), r in zip(ROWS, roots, strict=True):
        members[r].append(doc_id)
    first = {r: min(m, key=lambda i: (i is None, i or 0)) for r, m in members.items()}
    wanted = Counter((doc_id, first[r], len(members[r])) for (doc_id, *_), r in zip(ROWS, roots, strict=True))
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == wanted
    assert sum(r["kept"] for r in got) == len(members)
    assert bagminhash.near_classes(nothing).count() == 0
    assert bagminhash.survivors(odd, ["doc_id", "source"]).count() == len(members)


def test_near_classes_of_chains_and_crowds(spark):
    """Chains of links, a crowd of near copies, and texts that only share a passage."""
    import random

    chance = random.Random(2)
    vocabulary = [f"w{i}" for i in range(4_000)]
    base = [chance.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(80):  # a crowd
        changed = list(base)
        changed[chance.randrange(120)] = "other"
        texts.append(" ".join(changed))
    chain = [chance.choice(vocabulary) for _ in range(150)]
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[4:] + [chance.choice(vocabulary) for _ in range(4)]
    passage = " ".join(base[:60])
    texts += [passage + " " + " ".join(chance.choice(vocabulary) for _ in range(90)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots = brute_classes(list(enumerate(texts)))
    wanted = defaultdict(set)
    for i, r in enumerate(roots):
        wanted[r].add(i)
    got = defaultdict(set)
    for r in bagminhash.near_classes(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("most", [2, 4, 50])
def test_signatures_are_unbiased(most):
    import numpy as np

    random = np.random.default_rng(most)
    agreed, true = [], []
    for _ in range(120):
        size = random.integers(2, 60)
        elements = random.integers(0, 2**63, size).astype(np.uint64)
        a = random.integers(0, most, size)
        b = np.where(random.random(size) < 0.7, a, random.integers(0, most, size))
        if a.any() and b.any():
            sides = [bagminhash.signature(elements[w > 0], w[w > 0]) for w in (a, b)]
            agreed.append((sides[0] == sides[1]).mean())
            true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agreed) - np.mean(true)) < 0.015
    # A component agrees with a probability of the similarity, so the error has a binomial spread.
    spread = np.mean([t * (1 - t) / 125 for t in true])
    assert np.mean((np.array(agreed) - true) ** 2) < 1.5 * spread


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rows = graphs.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    got = {r["node"]: r["component"] for r in rows}
    wanted = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == wanted and len(rows) == len(wanted)


def test_languages(odd, nothing, spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs, ~queries.held_out(4, 2))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t for i, t, *_ in ROWS if i == r["doc_id"]]
        letters = {any(c.isalpha() for c in t or "") for t in texts}
        if len(letters) == 1:
            assert (r["lang_pred"] == "und") == (not letters.pop())
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0)
    assert langid.predict(nothing, model).count() == 0
    empty = langid.fit(nothing.select("doc_id", "text", "lang"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


def test_language_vectors_equal_plain_sums():
    """Bundles made in slices equal the sum over n-grams, letter by letter."""
    import numpy as np

    made = langid.Profiler(64)
    text = "Das ist, ja: été́!"
    codes = made.codes
    padded = [0]
    for c in text.lower() + " ":
        code = int(codes[ord(c)])
        if code or padded[-1]:
            padded.append(code)
    plain = np.zeros(64)
    for i in range(len(padded) - 2):
        plain += np.prod([made.placed[j][padded[i + j]] for j in range(3)], axis=0)
    bundle = made.bundle([None, text, "", text * 2])
    assert np.array_equal(bundle[1], plain) and not bundle[0].any() and not bundle[2].any()


def test_language_accuracy(spark):
    rows = queries.op3_langid(spark, DATA.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    held = rows.where("held_out").join(docs, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_toxicity(odd, nothing, spark):
    folder = DATA.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = toxicity.fit(docs, labels, ~queries.held_out(5, 0))
    scored = toxicity.score(docs.join(labels, "doc_id"), net, ["doc_id", "toxic"])
    rows = scored.where(queries.held_out(5, 0)).collect()
    caught = [r["score"] >= 0.5 for r in rows if r["toxic"] == 1]
    alarms = [r["score"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(alarms) / len(alarms) < 0.07
    scores = toxicity.score(odd, net).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    by_id = {r["doc_id"]: r["score"] for r in scores}
    assert by_id[14] > 0.5 > by_id[4] == by_id[5] == by_id[6]
    assert toxicity.score(nothing, net).count() == 0
    # One window of a long text is enough, wherever it lies.
    clean = next(r["text"] for r in docs.where("doc_id = 1009 or doc_id = 5").collect())
    plain, hidden = toxicity.Scorer(net).logits([clean, f"{clean} idiot scum {clean}"])
    assert hidden > max(0, plain)
    assert toxicity.fit(docs, labels.where("false"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_windows_cover_all_words():
    for words in range(0, 200):
        starts = list(toxicity.window_starts(words))
        covered = {i for s in starts for i in range(s, min(words, s + toxicity.WINDOW))}
        assert covered == set(range(words)) and all(s < max(1, words) for s in starts)


def test_toxicity_gradient():
    """The gradient equals numeric differences of the loss."""
    import numpy as np

    random = np.random.default_rng(0)
    odds = random.standard_normal(toxicity.CHAR_BUCKETS)  # no ties, where the largest value has no slope
    net = toxicity.Network.fresh({"aa": 1, "bb": 2}, np.array([0, 0.5, -0.5]), odds)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, labels = [["aa", "zz", "bb"], ["bb"], ["qq", "aa"]], np.array([1, 0, 1])

    class Never:
        def random(self, shape):
            return np.ones(shape)

    def loss():
        logit = toxicity.scores_of(net, windows).astype(float)
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    grad = toxicity.train_step(net, windows, labels, Never())
    for name, part in net.weights.items():
        for _ in range(3):
            at = tuple(random.integers(0, n) for n in part.shape)
            if name == "word":
                at = (1, at[1])
            elif name == "char":
                at = (int(toxicity.letter_grams(["aa"])[0][0][0]), at[1])
            old = part[at]
            part[at] = old + 2e-3
            up = loss()
            part[at] = old - 2e-3
            down = loss()
            part[at] = old
            assert abs((up - down) / 4e-3 - grad[name][at]) < 2e-3, (name, at)


def test_licenses(odd, nothing, spark):
    rows = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert rows[13]["licenses"] == ["MIT", "all-rights-reserved"]
    assert rows[13]["places"] == [0, 1] and rows[13]["n_sentences"] == 2
    assert rows[4]["n_sentences"] == 0 and rows[5]["licenses"] == [] and rows[6]["places"] == []
    assert licenses.scan(odd).count() == len(ROWS) and licenses.scan(nothing).count() == 0
    whole = " ".join([licenses.SENTENCES["s01"], licenses.SENTENCES["s02"]])
    cases = [
        (whole, ["MIT"]),
        (whole.upper().replace(" ", "\n  "), []),  # line ends cut sentences
        (licenses.SENTENCES["s15"] + "\n" + licenses.SENTENCES["s04"], ["BSD"]),
        (licenses.SENTENCES["s15"] + " Other words. " + licenses.SENTENCES["s04"], ["all-rights-reserved", "BSD"]),
        (licenses.SENTENCES["s12"] * 1 + " " + licenses.SENTENCES["s12"], ["MIT", "MIT"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert got == {i: names for i, (_, names) in enumerate(cases)}


MIT = """MIT License

Copyright (c) 2020 Some Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, Some Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NEITHER = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}\n" for line in text.splitlines())


def test_licenses_of_wrapped_texts(odd, nothing, spark):
    cases = [
        (MIT, ["MIT"]),
        (MIT.replace("\n\nP", "\nP").replace("\n", "\r\n"), ["MIT"]),  # a heading without a blank line
        (BSD, ["BSD-2-Clause"]),
        (BSD + NEITHER, ["BSD-3-Clause"]),
        (GPL3, ["GPL-3.0-or-later"]),
        (GPL3.replace("software:", "software;").replace(", either version 3", "; either version 2"), ["GPL-2.0-or-later"]),
        (GPL3.replace("General", "Affero General"), ["AGPL-3.0-or-later"]),
        (LGPL, ["LGPL-2.1-or-later"]),
        ("// SPDX-License-Identifier: MIT\n#include <stdio.h>\n", ["MIT"]),
        ("/* SPDX-License-Identifier: GPL-2.0+ */\nint x;", ["GPL-2.0-or-later"]),
        ("Plain words about MIT\nand licences", []),
    ]
    for mark in ("#", " *", "//", ";;", "dnl", "--"):
        cases += [(commented(MIT, mark), ["MIT"]), (commented(BSD + NEITHER, mark), ["BSD-3-Clause"])]
        cases += [(commented(GPL3, mark), ["GPL-3.0-or-later"])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_texts(docs).collect()}
    assert got == {i: names for i, (_, names) in enumerate(cases)}
    # What line by line reading finds, is found too.
    lines = {r["doc_id"]: r["licenses"] for r in licenses.scan(odd).collect()}
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan_texts(odd).collect()} == lines
    assert licenses.scan_texts(nothing).count() == 0


def test_toxicity_learns_from_long_texts_and_from_copies(spark):
    import random

    chance = random.Random(4)
    words = [f"w{i}" for i in range(3_000)]
    plain = [" ".join(chance.choices(words, k=60)) for _ in range(60)]
    hidden = [f"{t} you idiot scum {t}" for t in plain]  # toxic copies of clean texts
    net = toxicity.train(plain + hidden, [0] * 60 + [1] * 60)
    logits = toxicity.Scorer(net).logits(plain + hidden)
    assert (logits[:60] < 0).mean() > 0.9 and (logits[60:] > 0).mean() > 0.9
    long = [" ".join(chance.choices(words, k=2_000)) for _ in range(40)]
    rows = [(i, t if i % 2 else t + " you idiot scum " + t[:1_000]) for i, t in enumerate(long)]
    docs = spark.createDataFrame([*rows, (100, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in [*range(40), 100, 101]], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels, F.lit(True)) is not None
    with pytest.warns(UserWarning, match="every score is 0"):
        assert toxicity.fit(docs.where("doc_id % 2 = 1"), labels, F.lit(True)) is None
    whole = docs.where("doc_id < 2").select(toxicity.excerpt(F.col("text"), 3_000).alias("t")).collect()
    assert all(len(r["t"]) <= 3_010 and r["t"].count(toxicity.PIECE_END) == 4 for r in whole)
    assert {r["t"] for r in docs.where("doc_id < 2").select(toxicity.excerpt(F.col("text"), 10**6).alias("t")).collect()} == {t for _, t in rows[:2]}


def test_workers_drop_what_other_operators_keep():
    from gleaner.llm import common

    kept = {"a": [1], "b": [2]}
    for name, values in kept.items():
        common.keeps(name, values.clear)
    common.claim("a")
    assert kept == {"a": [1], "b": []}
    kept["b"].append(3)
    common.claim("a")  # the same operator again: nothing goes
    assert kept == {"a": [1], "b": [3]}
    common.claim("b")
    assert kept == {"a": [], "b": [3]}
    for name in kept:
        del common._stores[name]


def test_language_vectors_are_bounded():
    import numpy as np

    texts = ["".join(chr(0x61 + (i * k) % 26) for i in range(400)) + chr(0xE0 + k % 20) for k in range(1, 40)]
    whole = langid.Profiler(64)
    small = langid.Profiler(64, most_bytes=64 * 50)
    assert np.array_equal(whole.bundle(texts), small.bundle(texts))
    assert len(small.vectors) < len(whole.vectors)


def test_toxicity_scorer_equals_a_walk_word_by_word():
    """All overlapping windows, one after the other, one word after the other."""
    import numpy as np

    random = np.random.default_rng(7)
    words = [f"word{i}" for i in range(60)]
    odds = random.standard_normal(toxicity.CHAR_BUCKETS).astype(np.float32)
    net = toxicity.Network.fresh({w: i for i, w in enumerate(words[:40], 1)}, np.zeros(41, np.float32), odds)
    w = net.weights
    size = toxicity.STATE

    def logistic(x):
        return 1 / (1 + np.exp(-x.astype(np.float64)))

    def window_logit(window):
        vectors = net.inputs(window)[0] if window else np.zeros((0, 1))
        states = {}
        for way, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            state = np.zeros(size)
            for t in order:
                x = vectors[t] @ w[way + "in"] + w[way + "bias"]
                inner = state @ w[way + "rec"]
                z, r = logistic(x[:size] + inner[:size]), logistic(x[size : 2 * size] + inner[size : 2 * size])
                new = np.tanh(x[2 * size :] + r * inner[2 * size :])
                state = z * state + (1 - z) * new
                states[way, t] = state
        if not window:
            return w["bias"][0]
        both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))])
        energy = np.tanh(both @ w["attend"]) @ w["focus"]
        share = np.exp(energy - energy.max())
        return (share / share.sum()) @ both @ w["out"] + w["bias"][0]

    texts = [" ".join(random.choice(words, n)) for n in (1, 7, 31, 32, 33, 40, 41, 95, 200)] + ["", None]
    wanted = []
    for text in texts:
        found = (text or "").split()
        starts = [s for s in range(0, len(found), toxicity.STRIDE) if s == 0 or s + toxicity.WINDOW - toxicity.STRIDE < len(found)]
        wanted.append(max(window_logit(found[s : s + toxicity.WINDOW]) for s in starts or [0]))
    assert np.allclose(toxicity.Scorer(net).logits(texts), wanted, atol=1e-4)


@pytest.mark.parametrize("nodes", [1, 4, 128])
def test_ring_equals_a_walk_row_by_row(spark, nodes):
    """Rows in ring order, each to the first shard with room among those it meets clockwise."""
    shards = 8
    docs = spark.range(3_001).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text")
    )
    points = ring.ring_points(spark, shards, nodes)
    ways = ring.ways(points, shards)
    crc, size = F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("bigint")
    at = ring.place(F.col("doc_id"), crc, size)
    buckets = max(ring.LEAST_BUCKETS, -(-3_001 // (len(points) * ring.ROWS_PER_CELL)))
    bucket = F.pmod(F.xxhash64("at", F.lit("cell")), F.lit(buckets))
    placed = docs.select("doc_id", at.alias("at")).withColumn("bucket", bucket).collect()
    rows = []
    for r in placed:
        arc = next((n for n, (p, _) in enumerate(points) if int(p) >= r["at"]), 0)
        rows.append((arc, r["bucket"], r["at"], r["doc_id"]))
    room = [3_001 // shards + (s < 3_001 % shards) for s in range(shards)]
    taken = [0] * shards
    waiting, wanted = sorted(rows), {}
    for step in range(shards):
        left = []
        for row in waiting:
            shard = ways[row[0]][step]
            if taken[shard] < room[shard]:
                wanted[row[3]] = (shard, taken[shard])
                taken[shard] += 1
            else:
                left.append(row)
        waiting = left
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in ring.bounded_ring(docs, shards, nodes).collect()}
    assert not waiting and got == wanted


def test_ring_with_a_shard_more(spark):
    """A ninth shard must take a ninth of the rows; bounded loads move some more."""
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    eight, nine = ({r["doc_id"]: r["shard"] for r in ring.bounded_ring(docs, n).collect()} for n in (8, 9))
    moved = sum(eight[i] != nine[i] for i in eight)
    assert 1_000 <= moved < 3_000
