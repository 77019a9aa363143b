"""The pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of documents, and columns that a table
has besides keep their names and values.

Null and empty texts pass all stages (they are near copies of each other, so one of each stays); rows without an id count
as the earliest in line dedup and as the last among near copies; rows that repeat are near copies. Texts may be of any
length. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmap.llm import bagminhash, line_dedup, mixing, packing, toxicity
from helixmap.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the network learns from the labels of these documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: Share of the longer document's words from which on a later document is a copy: nothing of it stays.
COPIES = 0.8


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text.

    A document that shares four fifths of its words, or of the other's if that is longer, with one earlier document is left
    empty: shreds of a near copy are no near copy any more, which the next stage could tell.
    """
    return line_dedup.cut_texts(docs, copies=COPIES)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near duplicates."""
    return bagminhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, drawn so that token weights meet the targets."""
    return mixing.sample(docs, mixing.PRODUCTION)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Most stages can't be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
