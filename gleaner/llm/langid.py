"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs.  A letter n-gram is bound by multiplying the vectors of
its letters, each rotated by its place.  A document bundles (adds) the vectors of all its n-grams,
a language bundles its training documents, and a document gets the language whose prototype has
the largest cosine with it.

Training reads at most ``per_language`` labelled documents of each language, chosen by a hash; the
bound is a parameter.  Everything else reads whole texts.  Texts are worked off in slices of
bounded length, and one long text in parts whose n-gram counts are added up, so memory is bounded.

Null texts and texts without a letter are ``und`` with score 0, also in training, where they and
rows without a language are left out.  If nothing can be learned, every text is ``und``.  Equal
cosines go to the language first in the alphabet.  Every row gives one row; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_arrow_batches, claim, keeps, slices

UNKNOWN = "und"
DIMENSIONS = 512
GRAM = 3
CODES = 128
PER_LANGUAGE = 2_000
SLICE_CHARS = 250_000
KEPT_BYTES = 32_000_000
SCALE = 1 << 20  # document vectors become integers, so that sums do not depend on their order
SEED = 8191


def letter_codes() -> np.ndarray:
    """A code for every code point: 0 for what is no letter, own codes for Latin letters.

    Other letters share the remaining codes by a hash of their code point.
    """
    codes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            if 0x61 <= point <= 0x7A:
                codes[point] = point - 0x60
            elif 0xDF <= point <= 0xFF:
                codes[point] = point - 0xDF + 27
            else:
                codes[point] = 60 + point * 2654435761 % 2**32 * (CODES - 60) // 2**32
    return codes


class Profiler:
    """Bundles of n-gram vectors for many texts at once.

    N-gram vectors that have been made are kept up to ``most_bytes``; beyond that they are made anew.
    """

    def __init__(self, dimensions: int = DIMENSIONS, most_bytes: int = KEPT_BYTES):
        self.codes = letter_codes()
        random = np.random.default_rng(SEED)
        signs = random.integers(0, 2, (CODES, dimensions), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(signs, GRAM - 1 - place, axis=1) for place in range(GRAM)]
        self.row_of = np.full(CODES**GRAM, -1, np.int32)
        self.vectors = np.zeros((0, dimensions), np.int8)
        self.most = most_bytes // dimensions

    def forget(self) -> None:
        self.row_of.fill(-1)
        self.vectors = self.vectors[:0].copy()

    def grams(self, text: str) -> np.ndarray:
        """Rows of the text's n-grams in the table of n-gram vectors; words are parted by a blank."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.codes[points]
        codes = np.concatenate([[0], codes, [0]]).astype(np.int32)
        codes = codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)]
        codes = np.concatenate([[np.int32(0)], codes]).astype(np.int32)
        if codes.size < GRAM:
            return np.zeros(0, np.int32)
        numbers = codes[: codes.size - GRAM + 1]
        for place in range(1, GRAM):
            numbers = numbers * CODES + codes[place : codes.size - GRAM + 1 + place]
        rows = self.row_of[numbers]
        if rows.size and rows.min() < 0:
            self._add(np.unique(numbers[rows < 0]))
            rows = self.row_of[numbers]
        return rows

    def _add(self, numbers: np.ndarray) -> None:
        bound = np.ones((numbers.size, self.vectors.shape[1]), np.int8)
        rest = numbers.copy()
        for place in reversed(range(GRAM)):
            bound *= self.placed[place][rest % CODES]
            rest //= CODES
        self.row_of[numbers] = np.arange(numbers.size) + len(self.vectors)
        self.vectors = np.concatenate([self.vectors, bound])

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One vector per text; zero where a text is null or has no letter."""
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        owners, grams = [], []
        size = 0
        for number, text in enumerate(texts):
            for at in range(0, len(text or ""), SLICE_CHARS):
                if len(self.vectors) > self.most:
                    self._add_up(out, owners, grams)
                    owners, grams, size = [], [], 0
                    self.forget()
                # Parts of a long text overlap by the letters of an n-gram that crosses the border.
                found = self.grams(text[max(0, at - GRAM + 1) : at + SLICE_CHARS])
                if size + found.size > 2 * SLICE_CHARS:
                    self._add_up(out, owners, grams)
                    owners, grams, size = [], [], 0
                owners.append(np.full(found.size, number, np.int32))
                grams.append(found)
                size += found.size
        self._add_up(out, owners, grams)
        return out

    def _add_up(self, out: np.ndarray, owners: list[np.ndarray], grams: list[np.ndarray]) -> None:
        if not grams or not sum(g.size for g in grams):
            return
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        used = np.zeros(len(self.vectors), bool)
        used[gram] = True
        local = np.cumsum(used, dtype=np.int64) - 1
        vectors = self.vectors[used].astype(np.float32)
        block = max(1, 1_000_000 // len(vectors))
        for low in range(int(owner[0]), int(owner[-1]) + 1, block):
            a, b = np.searchsorted(owner, [low, low + block])
            if a < b:
                cells = (owner[a:b] - low) * np.int64(len(vectors)) + local[gram[a:b]]
                rows = int(owner[b - 1]) - low + 1
                counts = np.bincount(cells, minlength=rows * len(vectors)).astype(np.float32)
                out[low : low + rows] += counts.reshape(rows, -1) @ vectors


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  # one unit vector per language


_profilers: dict[int, Profiler] = {}
keeps("langid", _profilers.clear)


def profiler(dimensions: int) -> Profiler:
    """One profiler per worker: n-gram vectors are made once, as long as there is room for them."""
    claim("langid")
    if dimensions not in _profilers:
        _profilers[dimensions] = Profiler(dimensions)
    return _profilers[dimensions]


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def fit(
    docs: DataFrame,
    trainable: Column,
    per_language: int = PER_LANGUAGE,
    dimensions: int = DIMENSIONS,
) -> Model:
    """Prototypes of all languages among the rows where ``trainable`` holds.

    Of each language about ``per_language`` documents are taken by a hash of their identifier and
    text.  Sums are made by Spark; one number per language and dimension reaches the driver.
    """
    bound_arrow_batches(docs.sparkSession)
    labelled = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)).alias("draw"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, dimensions), np.float32))
    shares = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, per_language / n)) + 1))]
    sample = labelled.where(F.col("draw") < F.element_at(F.create_map(*shares), F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = profiler(dimensions)
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for part, texts in slices(batch, "text", SLICE_CHARS):
                whole = np.rint(_unit(made.bundle(texts)) * SCALE).astype(np.int64)
                for lang, vector in zip(part.column("lang").to_pylist(), whole, strict=True):
                    sums[lang] = sums.get(lang, 0) + vector
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(list(sums), pa.string()),
                    "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64())),
                }
            )

    bundles = sample.select("lang", "text").mapInArrow(run, "lang string, vector array<bigint>")
    summed = bundles.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    languages = sorted(counts)
    prototypes = np.zeros((len(languages), dimensions))
    for r in summed.collect():
        prototypes[languages.index(r["lang"]), r["at"]] = r["x"]
    return Model(languages, _unit(prototypes).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``, the cosine with that language, 0 at least."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    clash = {"lang_pred", "score", "_text"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep have names of new columns: {sorted(clash)}")
    column = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if column in keep else docs.select(*keep, F.col("text").alias(column))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = sent.value.languages, sent.value.prototypes
        made = profiler(prototypes.shape[1])
        for batch in batches:
            for part, texts in slices(batch, column, SLICE_CHARS):
                vectors = made.bundle(texts)
                known = vectors.any(axis=1) if languages else np.zeros(len(texts), bool)
                names: list[str] = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                if known.any():
                    cosines = _unit(vectors) @ prototypes.T
                    best = cosines.argmax(axis=1)
                    scores = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float)
                    names = [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                kept = {c: part.column(c) for c in keep}
                yield pa.RecordBatch.from_pydict(
                    kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, lang_pred string, score double" if keep else "lang_pred string, score double"
    return rows.mapInArrow(run, schema)
