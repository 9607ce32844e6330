"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession, size: str = "4m") -> None:
    """Cut Arrow batches by bytes too, so that very long texts cannot fill a Python worker."""
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, size)


def slices(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive parts of a batch with about ``max_chars`` bytes of text each, one row at least."""
    start = total = 0
    texts: list = []
    for value in batch.column(column):
        text = value.as_py()
        texts.append(text)
        total += len(text) if text else 0
        if total >= max_chars:
            yield batch.slice(start, len(texts)), texts
            start, total, texts = start + len(texts), 0, []
    if texts:
        yield batch.slice(start, len(texts)), texts


def count_up_to(key: Column, bounds: Sequence[str]) -> Column:
    """How many of the ascending ``bounds`` are not above the string ``key``.

    The search goes over every step-th bound, then over one step.  Bounds must not hold a line
    feed: the list travels as one literal and is split when the plan is folded.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every = F.split(F.lit("\n".join(bounds)), "\n")
    coarse = F.split(F.lit("\n".join(bounds[step - 1 :: step])), "\n")
    skipped = F.size(F.filter(coarse, lambda x: x <= key)) * F.lit(step)
    fine = F.filter(F.slice(every, skipped + 1, F.lit(step)), lambda x: x <= key)
    return skipped + F.size(fine)


# What a Python worker keeps from task to task: how each operator empties its own store, and which
# operator ran last.  Workers live as long as their executor and serve one stage after the other.
_stores: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Declare that ``owner`` keeps something in its workers, and how to drop it."""
    _stores[owner] = forget


def claim(owner: str) -> None:
    """Called first in a task: if another operator ran last in this worker, what all others keep goes."""
    if _last == [owner]:
        return
    _last[:] = [owner]
    for name, forget in _stores.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    # The C library keeps freed pieces unless it is told to give them back.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
