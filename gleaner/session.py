"""Session helper and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Group by (key, chunk) really spreads by both, also after a join on the key alone.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


# Paths of the tables cut_lineage has written in the innermost ``scratch`` of this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; extra settings as keyword pairs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; elsewhere the setting is
    required, since a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For tables that several branches of a plan read: the text work behind them then runs once,
    and a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    if (scope := _written.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that ``cut_lineage`` has written inside.

    For long-running jobs: results must be written elsewhere before the end.  Each use has a list
    of its own, so jobs in other threads keep their tables.
    """
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for name in own:
            path = hadoop(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_arrow_batches(spark: SparkSession, size: str = "4m") -> None:
    """Cut Arrow batches by bytes too, so that very long texts cannot fill a Python worker."""
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, size)


SMALL_TABLE_BYTES = 64 * 1024 * 1024

def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join in which no side may be broadcast, because all of them grow with the input.

    The planner takes a table of exploded or compressed rows for far smaller than it is, and what it
    broadcasts lies whole in the driver.
    """
    return df.hint("merge")


# Bound of a broadcast whose other side is narrow too, so that its shuffle is cheap: the driver and every
# executor hold a broadcast whole, and a job may need several at a time.
KEY_TABLE_BYTES = 8 * 1024 * 1024
# What a row of a broadcast takes besides its values.
BROADCAST_ROW_BYTES = 64


def broadcast_if_small(df: DataFrame, max_bytes: int = SMALL_TABLE_BYTES) -> DataFrame:
    """``df`` stored once, with a broadcast hint only if its measured size allows it.

    The planner cannot see the size of a derived table and would shuffle the large side of the
    join as well.  A table above the bound is joined by shuffle, where adaptive execution splits
    skewed keys.
    """
    stored = cut_lineage(df)
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(stored) if (size or 0) <= max_bytes else stored


def with_keys_of(rows: DataFrame, asked: DataFrame, keys: Sequence[str], max_bytes: int = KEY_TABLE_BYTES) -> DataFrame:
    """The narrow ``rows`` that share their ``keys``, which are not null, with a row of ``asked``.

    ``asked`` grows with a micro-batch, so it is broadcast only while it takes little memory in the
    driver.  Beyond that both sides are shuffled, and the result is stored, so that later steps do not
    take over a layout by key that keeps a hot key in one task.
    """
    few = cut_lineage(asked.select(*keys).distinct())
    size, count = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.count("*")).first()
    if (size or 0) + count * BROADCAST_ROW_BYTES <= max_bytes:
        return rows.join(F.broadcast(few), list(keys), "left_semi")
    return cut_lineage(rows.join(by_shuffle(few), list(keys), "left_semi"))
