"""Queries that arrive as a stream, mapped onto a static index.

Sketching and the seed join are stateless and run as plans of the stream; what follows groups a query's own rows, which
all lie in one micro-batch, so a batch is mapped as a table is. No state is kept and nothing can be late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from helixmap.operators.index import Index
from helixmap.operators.mapping import map_queries
from helixmap.operators.sketch import sketch
from helixmap.plans.params import MapParams


def seed_stream(queries: DataFrame, index: Index) -> DataFrame:
    """Minimizers of a stream of queries (qid, seq) joined with the index: a stream-static join."""
    mini = sketch(queries, "qid", index.params.k, index.params.w)
    return mini.join(index.seeds.select("hash", "rid", F.col("pos").alias("r_pos"), F.col("strand").alias("r_strand"), "n"), "hash")


def map_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, params: MapParams | None = None) -> StreamingQuery:
    """Appends the alignments of each micro-batch to Parquet, a folder a batch; a repeated batch replaces its own."""

    def batch(rows: DataFrame, epoch: int) -> None:
        map_queries(rows, index, params).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
