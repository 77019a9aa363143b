"""A uniform shuffle into shards of exact sizes, drawn through a communication matrix.

Rows are dealt into blocks by a hash of their content. The matrix that tells how many rows go from each block to each
shard is drawn block by block from the multivariate hypergeometric distribution, which is the distribution it has
when all rows are permuted uniformly and cut into shards of the given sizes. Rows are then permuted within their block
(by a seeded hash), leave for the shards as the matrix says, and are permuted again within their shard. Only DataFrame
operations touch rows; the driver sees one count a block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmap.llm.common import fresh, inline

#: Rows of a block, and of a part of a shard; the number of blocks is bounded, so that what the driver draws is too.
BLOCK_ROWS = 4_000
MAX_BLOCKS = 32_768


def communication_matrix(blocks: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows from each block to each shard: row sums are ``blocks``, column sums differ by one at most."""
    draw = np.random.default_rng(seed)
    total = sum(blocks)
    room = np.full(n_shards, total // n_shards, np.int64)
    room[draw.permutation(n_shards)[: total % n_shards]] += 1
    out = np.zeros((len(blocks), n_shards), np.int64)
    for i, n in enumerate(blocks):
        left = int(room.sum())
        for s in range(n_shards):  # one hypergeometric draw a cell: any population size works
            if n == 0:
                break
            good, bad = int(room[s]), left - int(room[s])
            k = n if bad == 0 else _draw(draw, good, bad, n)
            out[i, s] = k
            n -= k
            left -= good
        room -= out[i]
    return out


def _draw(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number; by inversion beyond the generator's limit of 10^9, which has the same law."""
    if good + bad < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, n))
    return inverted(draw.random(), good, bad, n)


def inverted(u: float, good: int, bad: int, n: int) -> int:
    """The least k whose distribution function exceeds ``u``, for the number of good ones among ``n`` that are drawn.

    Weights go from the mode to both sides by their exact ratios. They are summed as far as fourteen deviations, beyond
    which nothing is left in double precision.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    deviation = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = 64 + int(14 * deviation)
    k = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    up = np.cumprod((good - k) / (k + 1) * ((n - k) / (bad - n + k + 1)))
    k = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(k / (good - k + 1) * ((bad - n + k) / (n - k + 1)))
    edges = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return mode - len(down) + min(int(np.searchsorted(edges, u * edges[-1], "right")), len(edges) - 1)


def shard(df: DataFrame, n_shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """``df`` with its shard, 0 to ``n_shards`` - 1, and its slot there, gapless from 0; law: rows.

    Whole rows move. Columns may have any names but the two added; those already there under these names are
    replaced. Rows whose columns are all equal are told apart arbitrarily. An empty table gives no rows. Columns of
    map type are not used for the permutation. Rows that are equal in all columns lie in one block, so that they are dealt
    together. Null, empty and very long texts are rows like others.
    """
    df = df.drop(shard_name, slot_name)
    keys = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    block, first, part, second, rank, ends, shift = fresh(df, "__block", "__first", "__part", "__second", "__rank", "__ends", "__shift")
    n = df.count()
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(n / block_rows)))
    parts = min(MAX_BLOCKS, max(1, math.ceil(n / n_shards / block_rows)))
    base = F.xxhash64(F.lit(seed), *keys)
    dealt = df.withColumn(first, base).withColumn(block, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(first)), F.lit(n_blocks)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy(block).agg(F.count("*")).collect()}
    sizes = [counts.get(b, 0) for b in range(n_blocks)]
    matrix = communication_matrix(sizes, n_shards, seed).cumsum(axis=1)
    table = inline(df.sparkSession, [{"b": b, "e": row.tolist()} for b, row in enumerate(matrix)], "b int, e array<bigint>")
    table = F.broadcast(table.select(F.col("b").alias(block), F.col("e").alias(ends)))  # at most MAX_BLOCKS rows

    here = F.row_number().over(Window.partitionBy(block).orderBy(first, *keys)).cast("long") - 1
    sent = dealt.withColumn(rank, here).join(table, block)
    sent = sent.withColumn(shard_name, F.size(F.filter(F.col(ends), lambda e: e <= F.col(rank))).cast("int"))
    sent = sent.withColumn(second, F.xxhash64(F.lit(seed + 2), F.col(first))).withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 3), F.col(first)), F.lit(parts)).cast("int"))
    slot = F.row_number().over(Window.partitionBy(shard_name, part).orderBy(second, first, *keys)).cast("long") - 1
    if parts == 1:
        out = sent.withColumn(slot_name, slot)
    else:
        before = F.sum("n").over(Window.partitionBy(shard_name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
        shifts = sent.groupBy(shard_name, part).agg(F.count("*").alias("n")).select(shard_name, part, F.coalesce(before, F.lit(0)).alias(shift))
        out = sent.withColumn(slot_name, slot).join(shifts, [shard_name, part]).withColumn(slot_name, F.col(slot_name) + F.col(shift))
    return out.select(*[f"`{c}`" for c in df.columns], shard_name, slot_name)
