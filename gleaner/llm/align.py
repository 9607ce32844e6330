"""Alignment of the tokens of two tokenizers by their byte offsets, and corpus counts of id pairs.

Tokenizer A sees a blank and the text, tokenizer B the text, before which it puts a blank itself.
Where tokens of both end at one byte the text is cut; what lies between two cuts is a group, and
every token occurrence of A in it is linked with every one of B in it.

All documents of a slice are merged in lockstep: one NumPy state vector holds an A and a B pointer
for each document.  A step compares the two ends of every document at once and moves the pointer
with the smaller end, or both at a cut, where it emits the cut and the links of the group that ends
there; documents that are through are compacted away.

Counts over the corpus: a slice of some megabytes of text becomes a chunk with a dictionary of the
id pairs in it and, for each, how many of its documents hold it.  Only dictionaries are shuffled and
added up, so a pair that is in every document costs one row per chunk.  The counts come back to the
chunk's dictionary, where the links of its documents, kept as positions in it, look them up.

A text has no tokens (all numbers 0, no digest) if it is null or empty or if the joined bytes of one
side are not a blank and the text, as for texts with U+2581.  Strings of special tokens are plain
text.  Long texts are aligned whole.  Repeated rows count as documents of their own.  An empty table
gives an empty one.  Only the columns in ``keep`` pass; one named like an output column is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bpe import ByteBPE
from gleaner.llm.common import bound_arrow_batches, claim, keeps, slices
from gleaner.llm.packing import WORDS
from gleaner.session import cut_lineage

SLICE_BYTES = 4_000_000
WIDE_GROUP = 256  # links of groups beyond it are counted by distinct ids, not one by one
BLANK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, definition: bytes, pieces: bytes):
        self.exact = ByteBPE(definition)
        self.exact.cut = None  # special tokens are plain text here
        special = {int.from_bytes(ids, "little") for ids in self.exact.special.values()}
        self.bytes_a = self.exact.strings
        ranks = {s: i for i, s in enumerate(self.bytes_a) if s and i not in special}
        self.a = tiktoken.Encoding("alignment", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [
            bytes.fromhex(found[1]) if (found := byte.fullmatch(name)) else name.replace(BLANK, " ").encode()
            for name in names
        ]
        self.length_a = np.array([len(s) for s in self.bytes_a], np.int64)
        self.length_b = np.array([len(s) for s in self.bytes_b], np.int64)
        # What each token adds to a written alignment: within a group, then at the end of its side.
        written = [f"{i}{mark}".encode() for mark in ",|" for i in range(len(self.bytes_a))]
        written += [f"{i}{mark}".encode() for mark in ",;" for i in range(len(self.bytes_b))]
        self.written = np.array(written, object)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, None for texts without tokens."""
        if not text:
            return None
        padded = " " + text
        try:
            a = self.a.encode_to_numpy(padded, disallowed_special=())
        except ValueError:  # white space without end is too deep for its pattern engine
            a = np.frombuffer(self.exact.encode(padded), np.uint32)
        b = self.b.encode(text)
        whole = padded.encode()
        # Tokens of A are the bytes of the text cut in pieces; those of B may stand for other bytes.
        strings = self.bytes_b
        if self.length_a[a].sum() != len(whole) or b"".join([strings[i] for i in b]) != whole:
            return None
        return a.astype(np.int32), np.array(b, np.int32)


def lockstep(
    ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of all documents in order, as token ranges (A from, A to, B from, B to).

    ``ends_a`` and ``ends_b`` are the byte ends of all tokens of all documents one after another;
    a document has the tokens ``from_a`` to ``to_a`` (not included) and those from ``from_b`` on.
    """
    a, b, last = from_a.copy(), from_b.copy(), to_a
    group_a, group_b = from_a.copy(), from_b.copy()
    emitted: list[tuple[np.ndarray, ...]] = []
    while a.size:
        end_a, end_b = ends_a[a], ends_b[b]
        a += end_a <= end_b
        b += end_b <= end_a
        cut = np.flatnonzero(end_a == end_b)
        if cut.size:
            past_a, past_b = a[cut], b[cut]
            emitted.append((group_a[cut], past_a, group_b[cut], past_b))
            group_a[cut], group_b[cut] = past_a, past_b
            left = a < last
            if not left.all():
                a, b, last = a[left], b[left], last[left]
                group_a, group_b = group_a[left], group_b[left]
    if not emitted:
        return (np.zeros(0, np.int64),) * 4
    columns = [np.concatenate(part) for part in zip(*emitted, strict=True)]
    # Groups begin at different tokens of A, so their order is read from the tokens they begin at.
    at = np.full(len(ends_a), -1, np.int32)
    at[columns[0]] = np.arange(len(columns[0]), dtype=np.int32)
    order = at[at >= 0]
    return tuple(c[order] for c in columns)


def linked_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, groups: tuple[np.ndarray, ...], owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, number of links) for all groups; pairs may come more than once."""
    from_a, to_a, from_b, to_b = groups
    high, wide = to_a - from_a, to_b - from_b
    size = high * wide
    few = np.flatnonzero(size <= WIDE_GROUP)
    of = np.repeat(few, size[few])
    at = np.arange(of.size) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    left = ids_a[from_a[of] + at // wide[of]].astype(np.int64)
    right = ids_b[from_b[of] + at % wide[of]]
    documents, pairs, links = [owner[of]], [left << 32 | right], [np.ones(of.size, np.int64)]
    for g in np.flatnonzero(size > WIDE_GROUP):
        one, ones = np.unique(ids_a[from_a[g] : to_a[g]], return_counts=True)
        two, twos = np.unique(ids_b[from_b[g] : to_b[g]], return_counts=True)
        pairs.append((one.astype(np.int64)[:, None] << 32 | two).ravel())
        links.append((ones[:, None] * twos).ravel())
        documents.append(np.full(pairs[-1].size, owner[g]))
    return np.concatenate(documents), np.concatenate(pairs), np.concatenate(links)


def packed(values: np.ndarray) -> bytes:
    """An array of whole numbers in compressed form, in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(values.max()) if values.size else 0)
    body = values.astype(kind).tobytes()
    return kind.char.encode() + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    body = pa.decompress(data[9:], size, codec="zstd", asbytes=True)
    return np.frombuffer(body, np.dtype(data[:1].decode())).astype(np.int64)


class Chunk:
    """The alignment of some texts.

    ``numbers`` and ``digests`` go by text; ``pairs`` is the dictionary with ``documents`` per pair.
    Links: for each text (``upto`` are running ends) its distinct pairs as ``places`` in the
    dictionary and the number of ``links`` of each.
    """

    def __init__(self, texts: Sequence[str | None], pair: Pair):
        sides = [pair.ids(text) for text in texts]
        used = np.array([n for n, s in enumerate(sides) if s is not None], np.int64)
        none = np.zeros(0, np.int32)
        ids_a = np.concatenate([none, *(s[0] for s in sides if s is not None)])
        ids_b = np.concatenate([none, *(s[1] for s in sides if s is not None)])
        count_a = np.array([len(s[0]) for s in sides if s is not None], np.int64)
        count_b = np.array([len(s[1]) for s in sides if s is not None], np.int64)
        del sides
        to_a, to_b = np.cumsum(count_a), np.cumsum(count_b)
        ends_a, ends_b = np.cumsum(pair.length_a[ids_a]), np.cumsum(pair.length_b[ids_b])
        groups = lockstep(ends_a, ends_b, to_a - count_a, to_a, to_b - count_b)
        owner = np.searchsorted(to_a, groups[0], side="right")
        size = (groups[1] - groups[0]) * (groups[3] - groups[2])
        n_groups = np.bincount(owner, minlength=used.size)
        n_links = np.zeros(used.size, np.int64)
        np.add.at(n_links, owner, size)
        self.numbers = np.zeros((len(texts), len(COUNTS)), np.int64)
        self.numbers[used] = np.stack([count_a, count_b, n_groups, n_links], axis=1)
        self.digests = [""] * len(texts)
        for n, digest in zip(used, self._digests(pair, ids_a, ids_b, groups, to_a, to_b), strict=True):
            self.digests[n] = digest
        documents, keys, links = linked_pairs(ids_a, ids_b, groups, owner)
        found, self.pairs = pd.factorize(keys, sort=True)
        size = self.pairs.size + 1
        first, held = pd.factorize(documents * size + found)
        total = np.bincount(first, links, minlength=held.size).astype(np.int64)
        # Documents come in order, but for their wide groups.
        order = np.argsort(held, kind="stable")
        held, self.links = held[order], total[order]
        self.places = held % size
        holder = used[held // size] if used.size else none
        self.documents = np.bincount(self.places, minlength=self.pairs.size)
        self.upto = np.cumsum(np.bincount(holder, minlength=len(texts)))

    @staticmethod
    def _digests(pair: Pair, ids_a, ids_b, groups, to_a, to_b) -> Iterator[str]:
        """SHA-256 of each text's groups, written as A ids, bar, B ids, semicolon."""
        from_a, past_a, from_b, past_b = groups
        many_a, many_b = len(pair.bytes_a), len(pair.bytes_b)
        ends_side_a, ends_side_b = np.zeros(ids_a.size, np.int64), np.zeros(ids_b.size, np.int64)
        ends_side_a[past_a - 1] = many_a
        ends_side_b[past_b - 1] = many_b
        symbols = np.empty(ids_a.size + ids_b.size, np.int64)
        symbols[np.arange(ids_a.size) + np.repeat(from_b, past_a - from_a)] = ids_a + ends_side_a
        symbols[np.arange(ids_b.size) + np.repeat(past_a, past_b - from_b)] = ids_b + ends_side_b + 2 * many_a
        start = 0
        for end in to_a + to_b:
            text = b"".join(pair.written[symbols[start:end]].tolist())
            yield sha256(memoryview(text)[:-1]).hexdigest()
            start = end


_loaded: dict[int, Pair] = {}
keeps("align", _loaded.clear)


def loaded(definition: Broadcast[bytes], pieces: Broadcast[bytes]) -> Pair:
    """Both tokenizers, built once in each worker."""
    claim("align")
    key = hash((definition.value, pieces.value))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(definition.value, pieces.value)
    return _loaded[key]


def chunks(
    docs: DataFrame, definition: Broadcast[bytes], pieces: Broadcast[bytes], text: str, keep: Sequence[str]
) -> DataFrame:
    """One row per chunk: its documents, its dictionary and the links of the documents."""
    bound_arrow_batches(docs.sparkSession)
    kept = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in keep)
    numbers = ", ".join(f"{c}: bigint" for c in COUNTS)
    document = f"struct<{kept + ', ' if kept else ''}{numbers}, groups_sha256: string>"
    arrays = ("pairs", "documents", "upto", "places", "links")
    schema = f"chunk bigint, docs array<{document}>, " + ", ".join(f"{name} binary" for name in arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(definition, pieces)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch, "_text", SLICE_BYTES):
                chunk = Chunk(texts, pair)
                columns = [part.column(c) for c in keep]
                columns += [pa.array(chunk.numbers[:, n]) for n in range(len(COUNTS))]
                columns.append(pa.array(chunk.digests, pa.string()))
                rows = pa.StructArray.from_arrays(columns, names=[*keep, *COUNTS, "groups_sha256"])
                listed = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows)
                data = {name: pa.array([packed(getattr(chunk, name))], pa.binary()) for name in arrays}
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "docs": listed} | data)
                number += 1

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def dictionaries(stored: DataFrame) -> DataFrame:
    """(chunk, pair, documents) of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = unpacked(row["pairs"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array(np.full(pairs.size, row["chunk"])),
                        "pair": pa.array(pairs),
                        "documents": pa.array(unpacked(row["documents"])),
                    }
                )

    return stored.select("chunk", "pairs", "documents").mapInArrow(
        run, "chunk bigint, pair bigint, documents bigint"
    )


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, count, best): documents per id pair, and whether no pair of its A id has more."""
    counts = cut_lineage(held.groupBy("pair").agg(F.sum("documents").alias("count")))
    of = F.shiftright("pair", 32)
    # One row per id of A, so the vocabulary bounds it.
    highest = counts.groupBy(of.alias("_a")).agg(F.max("count").alias("_highest"))
    return counts.join(F.broadcast(highest), of == F.col("_a")).select(
        "pair", "count", (F.col("count") == F.col("_highest")).alias("best")
    )


def align(
    docs: DataFrame,
    definition: Broadcast[bytes],
    pieces: Broadcast[bytes],
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per row."""
    added = [*COUNTS, "n_best", "count_sum", "groups_sha256"]
    if clash := set(added) & set(keep):
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    stored = cut_lineage(chunks(docs, definition, pieces, text, keep))
    held = dictionaries(stored)
    counted = held.join(pair_counts(held), "pair").select("chunk", "pair", "count", "best")

    def look_up(key: tuple, chunk: pa.Table, dictionary: pa.Table) -> pa.Table:
        rows = chunk.column("docs").combine_chunks().flatten()
        order = np.argsort(dictionary.column("pair").to_numpy())
        upto, places, links = (unpacked(chunk.column(c)[0].as_py()) for c in ("upto", "places", "links"))
        columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        for name, source in (("n_best", "best"), ("count_sum", "count")):
            value = dictionary.column(source).to_numpy()[order].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(links * value[places])])
            columns[name] = pa.array(np.diff(sums[np.concatenate([[0], upto])]))
        return pa.table({name: columns[name] for name in [*keep, *added]})

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    numbers = ", ".join(f"{c} bigint" for c in added[:-1])
    left = stored.select("chunk", "docs", "upto", "places", "links").groupBy("chunk")
    return left.cogroup(counted.groupBy("chunk")).applyInArrow(look_up, f"{kept}{numbers}, groups_sha256 string")
