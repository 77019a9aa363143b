"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a table of signed events. Committing it sums the events to one row a group and writes that small table
under the batch's id; Spark's own success marker, written last, is the commit. A batch whose marker is there is not
written again, so a repeated commit changes nothing, whatever its events, and one that died half-way is overwritten. Totals
are the sum over all committed batches, each of which has one row a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmap.llm.common import cut, shared_folder, tidy, whole_text
from helixmap.llm.tokens import token_ids

GROUP = ["source", "lang", "tokenizer_version"]
MEASURES = ["docs", "tokens", "n_bytes"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in GROUP] + [T.StructField(c, T.LongType()) for c in MEASURES])


class Rollup:
    """A folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[str]:
        """Ids of the batches that are committed, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if s.isDirectory()]
        return sorted(n.removeprefix("batch-") for n in names if n.startswith("batch-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Adds the events of a batch once; False when the batch was there already.

        ``events``: source, lang, tokenizer_version, docs, tokens, n_bytes, the last three signed. Null labels are a
        group of their own; null measures count as 0; extra columns are ignored; an empty batch is committed too.
        """
        if batch_id in self.committed():
            return False
        sums = events.groupBy(*[F.col(c).cast("string").alias(c) for c in GROUP]).agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in MEASURES])
        sums.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """One row a group that still has documents, tokens or bytes."""
        names = [f"{self.path}/batch-{b}" for b in self.committed()]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*names)
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES])
        return sums.where(" or ".join(f"{c} <> 0" for c in MEASURES))


def inserts(counted: DataFrame) -> DataFrame:
    """Events that add documents with their counts."""
    return counted.withColumn("docs", F.lit(1).cast("long")).select(*GROUP, *MEASURES)


def deletes(counted: DataFrame) -> DataFrame:
    """Events that take documents away with the counts they were added with."""
    return inserts(counted).withColumns({c: -F.col(c) for c in MEASURES})


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that replace counts: the old ones are taken away, the new ones added."""
    return deletes(before).unionByName(inserts(after))


def count_tokens(docs: DataFrame, vocabularies: list[str], folder: str | None = None) -> DataFrame:
    """doc_id, source, lang, text_md5, n_bytes and ``tokens``, an array by vocabulary, of every whole text.

    A null text is empty and has no tokens; each repeated row is counted; null ids and labels stay null; extra columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(5).to_pylist()
            counts = [[len(token_ids(x, v, folder)) for v in vocabularies] for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(counts, pa.list_(pa.int64()))], [*batch.schema.names[:5], "tokens"])

    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.md5(text.cast("binary")).alias("text_md5"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"),
    )
    return rows.mapInArrow(tidy(run), "doc_id long, source string, lang string, text_md5 string, n_bytes long, tokens array<long>")


def corpus_history(docs: DataFrame, vocabularies: list[str], path: str | None = None) -> DataFrame:
    """Totals of a corpus after a history of four commits.

    Every document is inserted under each tokenizer version; exact copies of a text but the one with the least doc_id
    (then source, then lang) are deleted; the documents left get revised counts, with one end token more; the first
    batch is committed again, which changes nothing. Tokenizing runs once, into a checkpoint of narrow rows.
    """
    spark = docs.sparkSession
    counted = cut(count_tokens(docs, vocabularies))
    label = F.array(*[F.lit(v) for v in vocabularies])

    def by_version(rows: DataFrame) -> DataFrame:
        return rows.select("source", "lang", "n_bytes", F.explode(F.arrays_zip(label.alias("v"), F.col("tokens").alias("t"))).alias("x")).select("source", "lang", F.col("x.v").alias("tokenizer_version"), F.col("x.t").alias("tokens"), "n_bytes")

    first = counted.groupBy("text_md5").agg(F.min(F.struct("doc_id", "source", "lang", "n_bytes", "tokens")).alias("r")).select("r.*")
    everything, kept = by_version(counted), by_version(first)
    store = Rollup(spark, path or shared_folder(spark, "rollup"))
    store.commit("1-insert", inserts(everything))
    store.commit("2-delete-copies", deletes(everything).unionByName(inserts(kept)))
    store.commit("3-revise", revisions(kept, kept.withColumn("tokens", F.col("tokens") + 1)))
    store.commit("1-insert", inserts(everything))
    return store.totals()
