"""The training-text pipeline: ``documents`` through five stages, each written as Parquet and read again.

A stage takes the session, what its predecessor kept, and the data folder. All but the last return the columns of
``documents``; the last returns the kept documents with their piece ids and the text decoded from them.

Defined cases of all stages: a null text counts as empty and, but for the last stage, stays null; rows repeated with id and
text are one text to the stages that drop copies, and each on its own to the others; a null id is an id; other columns
stay as they are, whatever their names; an empty table gives an empty table. A very long text is held by one task, in
a multiple of its size that the operators' modules name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import decontamination, exact_dedup, near_dedup, quality, sentencepiece_codec
from sentrel.llm.batches import stored
from sentrel.llm.queries import PIECE_VOCABULARY, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels that is all of them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; null and empty texts are one text."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; a text without words equals only itself."""
    return near_dedup.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; a text without words has none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, and whether these give the text back; a null or empty text has no pieces."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sentencepiece_codec.round_trip(rows, public_tokenizers.path(PIECE_VOCABULARY))
    return rows.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "exact")


STAGES = [
    ("quality", keep_good_documents),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

#: A trained network, sampled bands and numpy searches have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
