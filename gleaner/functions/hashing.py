"""Content hashes: SHA-256 of the text, 64-bit simhash, bands and Hamming distance."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleaner import fixed_values as fixed

BANDS = 4
BAND_BITS = 16
SLICE_CHARS = 1 << 19
CACHED_TOKENS = 100_000
CACHED_LENGTH = 40

# Batch functions travel to the workers by value, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _both_cases(pattern: str) -> str:
    """A repeated character class as one that needs no ``IGNORECASE``, which is slow.

    What ignoring case adds is asked of the engine, character by character.
    """
    one = re.compile(re.sub(r"\{.*\}$", "", pattern), re.IGNORECASE)
    repeat = re.search(r"\{.*\}$", pattern)
    taken = one.findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    return f"[{re.escape(''.join(taken))}]{repeat[0] if repeat else ''}"


_find_tokens = re.compile(_both_cases(fixed.TOKEN_PATTERN)).findall


def text_hash(text_norm: Column) -> Column:
    return F.sha2(text_norm, 256)


def _blake2b_digest(token: str) -> bytes:
    return hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()


def _md5_digest(token: str) -> bytes:
    return hashlib.md5(token.encode("utf-8")).digest()[:8]


# The first is the hash of the source rules; the second is one that any SQL engine has.
TOKEN_DIGESTS: dict[str, Callable[[str], bytes]] = {
    "blake2b": _blake2b_digest,
    "md5": _md5_digest,
}


class _Digests(dict):
    """Digests of tokens; those of recent short tokens are kept, a bounded number of them."""

    def __init__(self, digest: Callable[[str], bytes]):
        super().__init__()
        self.digest = digest

    def __missing__(self, token: str) -> bytes:
        found = self.digest(token)
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = found
        return found


def _majority_bits(texts: pd.Series, digest: Callable[[str], bytes] | _Digests) -> np.ndarray:
    """Simhash of each text of one Arrow batch, a slice of texts with a bounded number of characters
    (one text at least) at a time: their tokens take many times the room of the texts."""
    digests = digest if isinstance(digest, _Digests) else _Digests(digest)
    results, part, chars = [], [], 0
    for text in texts:
        part.append(text)
        chars += len(text) if text is not None else 0
        if chars >= SLICE_CHARS:
            results.append(_slice_bits(part, digests))
            part, chars = [], 0
    results.append(_slice_bits(part, digests))
    return np.concatenate(results)


def _slice_bits(texts: list[str | None], digests: _Digests) -> np.ndarray:
    """Simhash of each text: the bits that more than half of its tokens' digests have."""
    result = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for row, text in enumerate(texts):
        tokens = _find_tokens(text) if text is not None else []
        if not tokens:
            continue
        joined = b"".join(map(digests.__getitem__, tokens))
        bits = np.unpackbits(np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones = bits.sum(axis=0, dtype=np.int64)
        result[row] = weights[2 * ones > len(tokens)].sum(dtype=np.uint64)
    return result.view(np.int64)


@F.pandas_udf(LongType())
def _simhash_blake2b(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    digests = _Digests(_blake2b_digest)
    for text in batches:
        yield pd.Series(_majority_bits(text, digests))


@F.pandas_udf(LongType())
def _simhash_md5(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    digests = _Digests(_md5_digest)
    for text in batches:
        yield pd.Series(_majority_bits(text, digests))


def simhash64(text_norm: Column, token_hash: str = "blake2b") -> Column:
    """64-bit simhash over token occurrences as a signed long; 0 for a text without tokens.

    A map-only Arrow batch function: nothing is shuffled, whatever the number of tokens.
    """
    if token_hash not in TOKEN_DIGESTS:
        raise ValueError(f"unknown token hash {token_hash!r}")
    return (_simhash_md5 if token_hash == "md5" else _simhash_blake2b)(text_norm)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(simhash: Column, index: int) -> Column:
    return F.shiftrightunsigned(simhash, index * BAND_BITS).bitwiseAND(
        F.lit((1 << BAND_BITS) - 1)
    )


def bands(simhash: Column) -> Column:
    """The four 16-bit bands, lowest first."""
    return F.array(*[band(simhash, i) for i in range(BANDS)])


_WIDE = "decimal(20,0)"


def _wide(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def to_unsigned64(value: Column) -> Column:
    """A signed long as the unsigned number with the same bits."""
    number = value.cast(_WIDE)
    return F.when(value < 0, number + _wide(1 << 64)).otherwise(number).cast(_WIDE)


def to_signed64(value: Column) -> Column:
    """An unsigned 64-bit number as the long with the same bits."""
    number = value.cast(_WIDE)
    return (
        F.when(number >= _wide(1 << 63), number - _wide(1 << 64)).otherwise(number).cast("bigint")
    )
