"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmap.llm import bagminhash, line_dedup, media, mixing, ngram_lm, packing, rollups, sharding, simhash, toxicity
from helixmap.llm.common import table, whole_text


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a PNG in archives, read back and described. Null texts are empty; rows that repeat are stored each; an empty table gives no rows."""
    return media.store_and_describe(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards, whose counts differ by one at most. Null texts have size 16; repeated rows are dealt each."""
    sharded = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text; null texts are one end, rows without an id are held out, repeated rows count each."""
    return ngram_lm.score_corpus(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 25 words or more that an earlier one has; null and empty texts stay as they are."""
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "kept_chars", "removed_lines", "removed_words", "removed_text", "partners")


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every row; null texts are empty, rows without an id have no say in class ids."""
    return bagminhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a network fitted to the labels that aren't held out; null texts are empty."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 2048 ids; null texts are the end id alone; repeated rows are packed each."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and vocabulary after inserts, deletion of copies, revision and a repeated commit; null labels are a group."""
    return rollups.corpus_history(table(spark, sf_dir, "documents"), ["byte_bpe_50k", "byte_bpe_multi_50k"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how many fingerprints are near; null texts are empty, null ids come last."""
    return simhash.edit_and_compare(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability, draw and verdict of every document under the production targets; null labels count as other."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.PRODUCTION)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), F.round("draw", 9).alias("draw"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_sharding": op2_sharding,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_line_dedup": op4_line_dedup,
    "op5_bagminhash": op5_bagminhash,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {"op10_mixing": mixing.mix_sql(mixing.PRODUCTION)}
