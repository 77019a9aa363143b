"""The seed index: minimizers of the references with the number of occurrences of their hash, and its thresholds.

Occurrences are counted with partial aggregation, so a hash that fills a third of all rows still makes one row a task;
hashes over the last threshold are dropped before their rows meet anything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmap.operators.sketch import sketch
from helixmap.plans.params import MapParams

UNLIMITED = (1 << 31) - 1


def counts(minimizers: DataFrame) -> DataFrame:
    """hash, n: occurrences of each hash."""
    return minimizers.groupBy("hash").agg(F.count("*").alias("n"))


def thresholds(count_table: DataFrame, frequencies: tuple[float, ...]) -> list[int]:
    """For each frequency the count that so large a share of keys exceeds or equals, plus one.

    The histogram of counts goes to the driver: it has at most the square root of twice the number of minimizers rows.
    Frequencies are taken in single precision. Without keys there is no limit.
    """
    rows = sorted((r["n"], r["keys"]) for r in count_table.groupBy("n").agg(F.count("*").alias("keys")).collect())
    total = sum(k for _, k in rows)
    out = []
    for f in frequencies:
        if f <= 0 or not total:
            out.append(UNLIMITED)
            continue
        rank, seen = min(math.floor((1.0 - float(np.float32(f))) * total), total - 1), 0
        for n, keys in rows:
            seen += keys
            if seen > rank:
                out.append(n + 1)
                break
    return out


@dataclass
class Index:
    """refs(rid, name, len, circular, seq), seeds(hash, rid, pos, strand, n), thresholds and parameters."""

    refs: DataFrame
    seeds: DataFrame
    occ: list[int]
    params: MapParams
    n_keys: int = 0
    #: Of an index that was just built: all minimizers, and the counts within the last threshold.
    minimizers: DataFrame | None = None
    kept: DataFrame | None = None

    def matching(self, hashes: DataFrame) -> DataFrame:
        """Seeds with one of the ``hashes`` (distinct). Counts are reduced first, so the other minimizers meet no shuffle
        where few hashes are asked for."""
        if self.kept is None:
            return self.seeds.join(hashes, "hash", "left_semi")
        return _counted(self.minimizers, self.kept.join(hashes, "hash", "left_semi"))

    def write(self, path: str, buckets: int | None = None) -> None:
        """Three Parquet tables; seeds are dealt and sorted by hash, so that readers prune by its range."""
        n = buckets or int(self.seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.refs.write.mode("overwrite").parquet(f"{path}/refs")
        self.seeds.repartitionByRange(n, "hash").sortWithinPartitions("hash", "rid", "pos").write.mode("overwrite").parquet(f"{path}/seeds")
        p = self.params
        meta = self.refs.sparkSession.createDataFrame([(p.k, p.w, p.codec, p.mixing_hash, self.n_keys, self.occ)], "k int, w int, codec string, mixing boolean, n_keys long, occ array<long>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, params: MapParams | None = None) -> Index:
    """A written index; its k, w and codec win over the parameters' defaults, and refuse others."""
    from dataclasses import replace

    m = spark.read.parquet(f"{path}/meta").first()
    base = params or MapParams()
    if params is not None and (params.k, params.w, params.codec, params.mixing_hash) != (m["k"], m["w"], m["codec"], m["mixing"]):
        raise ValueError(f"the index has k={m['k']}, w={m['w']}, codec={m['codec']}, mixing={m['mixing']}")
    own = replace(base, k=m["k"], w=m["w"], codec=m["codec"], mixing_hash=m["mixing"])
    return Index(spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/seeds"), list(m["occ"]), own, m["n_keys"])


def with_circular(refs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Marks the references that are circular: those named, or all by ``*``."""
    flag = F.lit(True) if "*" in names else F.col("name").isin(*names) if names else F.lit(False)
    return refs.withColumn("circular", flag)


def _counted(minimizers: DataFrame, kept: DataFrame) -> DataFrame:
    return minimizers.join(kept, "hash").select("hash", "rid", "pos", "strand", F.col("n").cast("int").alias("n"))


def build_index(refs: DataFrame, params: MapParams) -> Index:
    """Indexes ``refs`` (rid, name, seq: base characters); one shuffle by hash and one small action.

    References shorter than the least length are left out; so are hashes over the last threshold.
    """
    refs = refs.where(F.length("seq") >= params.min_len).withColumn("len", F.length("seq"))
    refs = with_circular(refs, params.circular).select("rid", "name", "len", "circular", "seq")
    mini = sketch(refs, "rid", params.k, params.w, circular="circular", mixing=params.mixing_hash)
    table = counts(mini).persist()  # read by the thresholds and by the join; a lost part is counted anew
    occ = thresholds(table, params.frequencies)
    kept = table.where(F.col("n") <= occ[-1])
    return Index(refs, _counted(mini, kept), occ, params, minimizers=mini, kept=kept)
