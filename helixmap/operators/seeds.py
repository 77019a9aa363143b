"""Seeds: query minimizers joined with the index, and their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_of(n: Column, occ: list[int]) -> Column:
    """The first round in which a seed with ``n`` occurrences takes part; null where it never does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(occ))):
        out = F.when(n <= occ[i], i).otherwise(out)
    return out


def join_seeds(queries: DataFrame, index: DataFrame, occ: list[int], k: int, lower_triangle: bool = False) -> DataFrame:
    """Seeds of query minimizers (qid, hash, pos, strand) in index rows (rid, hash, pos, strand, n).

    rpos and qpos are those of the joined k-mers, qpos negative when the strands differ: then it is ~(start + k - 1 + 1)
    counted from the query's end side. u = 2r - q and v = 2q - r; u + v = r + q. With ``lower_triangle`` only pairs with
    rid > qid stay, for a table against itself.
    """
    q = queries.select(F.col("qid"), "hash", F.col("pos").alias("q_pos"), F.col("strand").alias("q_strand"))
    r = index.select(F.col("rid"), "hash", F.col("pos").alias("r_pos"), F.col("strand").alias("r_strand"), "n")
    pairs = q.join(r, "hash")
    if lower_triangle:
        pairs = pairs.where(F.col("rid") > F.col("qid"))
    return coordinates(pairs, k).withColumn("round", round_of(F.col("n"), occ)).where(F.col("round").isNotNull())


def coordinates(pairs: DataFrame, k: int) -> DataFrame:
    """qid, rid, hash, n, rpos, qpos, u and v of joined minimizers.

    A reverse query k-mer has the signed position ~(start + k). A reverse reference k-mer flips both: the reference
    position moves by k and the query position is complemented again. So same strands give qpos >= 0.
    """
    start = F.col("q_pos").cast("long")
    signed = F.when(F.col("q_strand") == 1, F.bitwise_not(start + k)).otherwise(start)
    rpos = F.col("r_pos").cast("long") + F.when(F.col("r_strand") == 1, k).otherwise(0)
    qpos = F.when(F.col("r_strand") == 1, F.bitwise_not(signed)).otherwise(signed)
    out = pairs.withColumn("rpos", rpos).withColumn("qpos", qpos)
    out = out.withColumn("u", 2 * F.col("rpos") - F.col("qpos")).withColumn("v", 2 * F.col("qpos") - F.col("rpos"))
    return out.select("qid", "rid", "hash", "n", "rpos", "qpos", "u", "v")


def positions(u: Column, v: Column) -> tuple[Column, Column]:
    """(r, q) back from u and v."""
    return ((2 * u + v) / 3).cast("long"), ((2 * v + u) / 3).cast("long")


def diagonal_bins(seeds: DataFrame, width: int = 64) -> DataFrame:
    """qid, rid, strand, bin, n_seeds: co-linear seeds counted by bins of the diagonal."""
    reverse = F.col("qpos") < 0
    bin_ = F.floor((F.col("rpos") - F.col("qpos")) / F.lit(float(width))).cast("long")
    return seeds.groupBy("qid", "rid", reverse.cast("int").alias("strand"), bin_.alias("bin")).agg(F.count("*").alias("n_seeds"))
