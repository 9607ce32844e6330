"""Merkle manifest and multiproofs against plain trees."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        found.append(nodes)
    return found


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) per row."""
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        other = n_chars
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            other = n_chars + 1
        by_lang[lang].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, other, text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels([r[1] for r in by_lang[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for at, (doc_id, digest, given) in enumerate(by_lang[lang]):
            siblings, folded = [], given
            for tree, place in ((trees[lang], at), (top, number)):
                for level in tree[:-1]:
                    sibling = level[place ^ 1] if place ^ 1 < len(level) else ""
                    siblings.append(sibling)
                    folded = h(sibling, folded) if place % 2 else h(folded, sibling)
                    place //= 2
            root = top[-1][0]
            out.append((doc_id, digest, trees[lang][-1][0], root, h(*siblings), folded, folded == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def proven(docs):
    changed, n_chars = merkle.tampered()
    return merkle.proofs(merkle.Manifest(docs, changed, {"n_chars": n_chars}))


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


ROWS = [
    *((n, f"text {n}", ["en", "fr", "de", "é", "z"][n % 11 % 5], "s", n) for n in range(230)),
    *((n, "only one", f"l{n}", None, None) for n in range(300, 306)),
    *[(7, "again", "en", "s", 7)] * 3,
    *[(7, "again, otherwise", "en", "s", 7)] * 2,
    (None, "no number", "en", "s", 3),
    (None, None, None, None, None),
    (2**60 + 1, "", "", "", 2**63 - 1),
    (-5, "long " * 100_000, "", "a\x00b", 0),
]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_proofs(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    rows = ROWS if bits > 1 else [r for r in ROWS if r[2] in ("en", "fr", None)][::9]
    docs = documents(spark, rows).repartition(5)
    assert key(proven(docs).collect()) == key(brute(rows))


@pytest.mark.parametrize("rows", [ROWS[:1], ROWS[:2], [(n, "", "en", "", 1) for n in range(5)]])
def test_small_trees(spark, rows):
    assert key(proven(documents(spark, rows)).collect()) == key(brute(rows))


def test_nothing(spark):
    assert proven(documents(spark, ROWS[:1]).where("false")).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 5, 64, 77])
def test_missing_nodes_are_the_least_that_lead_to_the_root(width):
    random = np.random.default_rng(width)
    whole = levels([h(str(n)) for n in range(width)])
    for size in {1, 2, width // 2, width} - {0}:
        places = random.choice(width, min(size, width), replace=False)
        needed = merkle.missing(places, width)
        assert len(needed) == len(set(needed))
        own = {int(p): whole[0][p].encode() for p in places}
        derived = merkle.derive(own, {c: whole[c[0]][c[1]].encode() for c in needed}, width)
        assert derived[-1][0].decode() == whole[-1][0]
        # Nothing that is needed follows from the leaves that are held.
        for level, place in needed:
            below = {int(p) >> level for p in places}
            assert place not in below and place ^ 1 in below
        for p in places:
            assert merkle.fold(own[int(p)], merkle.siblings(derived, int(p), width)) == derived[-1][0]


def test_proofs_of_some_leaves_only(spark):
    """A few leaves of a partition fetch siblings from inside it too."""
    rows = [(n, f"text {n}", "en" if n % 3 else "fr", "s", n) for n in range(100)]
    changed, n_chars = merkle.tampered()
    manifest = merkle.Manifest(documents(spark, rows), changed, {"n_chars": n_chars})
    some = merkle.proofs(manifest, manifest.leaves.where(F.col("doc_id") % 17 == 0)).collect()
    assert key(some) == key(r for r in brute(rows) if r[0] % 17 == 0)
