"""A training corpus from ``documents``: language, toxicity, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; each result is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
Null and empty texts are rejected by the first stage, because they have no language; what the
later stages do with them stands in their operators.  An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from gleaner.llm import bagminhash, bpe, contentsort, langid, packing, toxicity
from gleaner.llm.common import table
from gleaner.llm.queries import TOKENIZER, held_out
from gleaner.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told apart go."""
    model = langid.fit(docs, ~held_out(4, 2))
    named = langid.predict(docs, model, COLUMNS)
    return named.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxic window go."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.score(docs, net, COLUMNS).where("score < 0.5").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest with the smallest identifier stays."""
    return contentsort.content_groups(docs, COLUMNS).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return bagminhash.survivors(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents, placed into sequences."""
    definition = bpe.load_definition(spark, tokenizer_path(TOKENIZER))
    pieces = packing.cut_pieces(docs, definition)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]

# Models, signatures and tokenizers have no SQL form; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
