"""Byte-level BPE: encoding by a queue of merge ranks over a linked symbol list, and decoding.

A text is cut into words by fixed character classes; each word starts as a doubly linked list of
byte symbols.  A heap holds the mergeable neighbours by rank, then position; entries that a merge has
made stale are skipped when they come up.  Words repeat, so a worker keeps the ids of recent ones.

Results are those of the public byte-level tokenizers: special tokens in a text become their own
ids and are never merged across.

Null and empty texts have no ids and decode to an empty text.  Every row gives one row; equal rows
give equal results.  Only the columns in ``keep`` pass, so other columns cannot clash with the new
ones; a ``keep`` column named like an output column is refused.  An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bound_arrow_batches, claim, keeps, slices

# Letters and numbers that Unicode 16 has added to Unicode 15.1, as first and last
# code point.  The tokenizers know them; Python's tables may be older.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
               (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
               (0x3000, 0x3000)]

BASIC_PLANE = 0xFFFF
CACHED_WORDS = 200_000
CACHED_LENGTH = 40
SLICE_CHARS = 2_000_000


def _class(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _up_to(last: int, ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(a, min(b, last)) for a, b in ranges if a <= last]


def _category(kind: str, added: list[tuple[int, int]], last: int) -> str:
    ranges: list[list[int]] = []
    for code in range(last + 1):
        if unicodedata.category(chr(code))[0] == kind:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return _class([(a, b) for a, b in ranges] + _up_to(last, added))


def word_pattern(last: int = 0x10FFFF) -> re.Pattern[str]:
    """Contractions, letters, numbers or other characters after at most one blank, white space.

    For texts without code points above ``last``.  Up to ``BASIC_PLANE`` a class is a bit map; ranges
    above it are tried one by one for each character that is in none, so for each end of a word.
    """
    space = _class(_up_to(last, WHITE_SPACE))
    letter, number = _category("L", LETTERS_16, last), _category("N", NUMBERS_16, last)
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_symbols(symbols: list[int], ranks: list[dict[int, int]], merged: list[int]) -> list[int]:
    """Merge the best-ranked neighbours until none is left; of equal ranks the leftmost first.

    ``ranks`` has the rank of each pair, by its first symbol, then its second; ``merged`` the symbol
    that each rank gives.
    """
    size = len(symbols)
    # An entry is one number, rank * size + position: quicker to make and compare than a pair.
    queue = [
        rank * size + at
        for at, rank in enumerate(map(dict.get, map(ranks.__getitem__, symbols), symbols[1:]))
        if rank is not None
    ]
    if not queue:
        return symbols
    heapq.heapify(queue)
    after = list(range(1, size + 1))
    before = list(range(-1, size))
    symbols.append(-1)  # the end: like a merged symbol, in no pair
    while queue:
        entry = heapq.heappop(queue)
        rank, at = entry // size, entry % size
        left, following = symbols[at], after[at]
        if left < 0 or ranks[left].get(symbols[following]) != rank:
            continue  # stale: one of the two has been merged meanwhile
        symbols[at] = left = merged[rank]
        symbols[following] = -1
        after[at] = beyond = after[following]
        before[beyond] = at
        if (rank := ranks[left].get(symbols[beyond])) is not None:
            heapq.heappush(queue, rank * size + at)
        if (at := before[at]) >= 0 and (rank := ranks[symbols[at]].get(left)) is not None:
            heapq.heappush(queue, rank * size + at)
    return [symbol for symbol in symbols if symbol >= 0]


class ByteBPE(dict):
    """A tokenizer; as a mapping it gives the ids of a word as little-endian 32-bit numbers."""

    def __init__(self, definition: bytes):
        super().__init__()
        loaded = json.loads(definition)
        vocabulary: dict[str, int] = loaded["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocabulary[letter] for letter in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"])
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocabulary[a]][vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.special = {text: array("I", [number]).tobytes() for text, number in special.items()}
        value = {letter: byte for byte, letter in enumerate(letters)}
        strings = {number: bytes(value[c] for c in text) for text, number in vocabulary.items()}
        strings |= {number: text.encode() for text, number in special.items()}
        self.strings = [strings.get(number, b"") for number in range(max(strings) + 1)]
        self.beyond = re.compile(f"[{chr(BASIC_PLANE + 1)}-{chr(0x10FFFF)}]").search
        self.basic_words, self.all_words = word_pattern(BASIC_PLANE).findall, word_pattern().findall
        self.cut = None
        if special:
            longest_first = sorted(special, key=len, reverse=True)
            self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def __missing__(self, word: str) -> bytes:
        first = self.first
        symbols = merge_symbols([first[b] for b in word.encode()], self.ranks, self.merged)
        ids = array("I", symbols).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        return self.all_words(text) if self.beyond(text) else self.basic_words(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        special = self.special
        return b"".join(
            special[part] if part in special else b"".join(map(self.__getitem__, self.words(part)))
            for part in self.cut.split(text)
            if part
        )

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_loaded: dict[int, ByteBPE] = {}
keeps("bpe", _loaded.clear)


def tokenizer(definition: Broadcast[bytes]) -> ByteBPE:
    """The tokenizer of a broadcast definition, built once in each worker."""
    claim("bpe")
    key = hash(definition.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(definition.value)
    return _loaded[key]


def load_definition(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """Send a tokenizer file (a few megabytes, whatever the data) to the executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _schema(df: DataFrame, keep: Sequence[str], added: str) -> str:
    clash = {part.split(" ")[0] for part in added.split(", ")} & set(keep)
    if clash:
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return f"{kept}, {added}" if kept else added


def encode(
    docs: DataFrame,
    definition: Broadcast[bytes],
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit numbers) and ``n_tokens``."""
    bound_arrow_batches(docs.sparkSession)
    column = "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(definition)
        for batch in batches:
            for part, texts in slices(batch, column, SLICE_CHARS):
                ids = [bpe.encode(text) for text in texts]
                counts = [len(x) // 4 for x in ids]
                kept = {c: part.column(c) for c in keep}
                yield pa.RecordBatch.from_pydict(
                    kept | {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array(counts, pa.int64())}
                )

    rows = docs.select(*keep, F.col(text).alias(column))
    return rows.mapInArrow(run, _schema(docs, keep, "ids binary, n_tokens bigint"))


def decode(encoded: DataFrame, definition: Broadcast[bytes], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded``: the vocabulary strings, joined, as text."""
    bound_arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(definition)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
            kept = {c: batch.column(c) for c in [*keep, "ids"]}
            yield pa.RecordBatch.from_pydict(kept | {"decoded": pa.array(texts, pa.string())})

    rows = encoded.select(*keep, "ids")
    return rows.mapInArrow(run, _schema(encoded, keep, "ids binary, decoded string"))
