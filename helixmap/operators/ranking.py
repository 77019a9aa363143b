"""Ranking of the alignment sets of a query, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mapping qualities carry four fractional bits and end at sixty.
QUALITY_BITS, QUALITY_MOST = 4, 60 << 4


def ranked(df: DataFrame, query: str, score: str, ties: list[str]) -> DataFrame:
    """Adds aid, the rank from 0 by falling score, and xs, the second score of the query or 0."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), *ties)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("aid", F.row_number().over(order) - 1).withColumn("xs", F.coalesce(F.nth_value(score, 2).over(whole), F.lit(0).cast(dict(df.dtypes)[score])))


def pruned(df: DataFrame, query: str, score: str, ratio: float) -> DataFrame:
    """Rows whose score is at least the whole part of ``ratio`` times the query's best."""
    best = F.max(score).over(Window.partitionBy(query))
    return df.withColumn("__best", best).where(F.col(score) >= F.floor(F.col("__best") * F.lit(ratio))).drop("__best")


def quality(score: Column, other: Column, identity: Column, coefficient: float) -> Column:
    """Mapping quality times 16 of a unique alignment; ``other`` is the greatest secondary score, or 0.

    The length that speaks for uniqueness is the score margin over the mean gain of a base; the error is one over its
    square plus one.
    """
    gain = F.lit(2.0) / (identity * F.lit(2.0 * coefficient) - F.lit(coefficient))
    length = gain * F.greatest(score - other, F.lit(0))
    error = F.lit(1.0) / (length * length + F.lit(1.0))
    return F.least(F.greatest(F.floor(F.lit(-160.0) * F.log10(error)), F.lit(0)), F.lit(QUALITY_MOST)).cast("int")


def identity_estimate(score: Column, gap_cost: Column, diagonals: Column, match: float, mismatch: float) -> Column:
    """Share of matches among the diagonals of a path, from its score; exact for a uniform matrix."""
    return ((score + gap_cost) / diagonals + F.lit(mismatch)) / F.lit(match + mismatch)


def edit_distance(diagonals: Column, identity: Column, gaps: Column) -> Column:
    return F.floor(diagonals * (F.lit(1.0) - identity)).cast("long") + gaps


def quality_all_vs_all(length: Column) -> Column:
    """Mapping quality times 16 where every sequence is a query and a reference: the error is one over the length plus one."""
    error = F.lit(1.0) / (length + F.lit(1.0))
    return F.least(F.greatest(F.floor(F.lit(-160.0) * F.log10(error)), F.lit(0)), F.lit(QUALITY_MOST)).cast("int")


def secondary_scores(df: DataFrame, query: str, score: str, is_uniq: str = "is_uniq") -> DataFrame:
    """``query`` with the greatest, least and summed score of its secondary alignments; 0 where it has none."""
    other = F.when(~F.col(is_uniq), F.col(score))
    return df.groupBy(query).agg(*[F.coalesce(f(other), F.lit(0)).cast("long").alias(name) for f, name in ((F.max, "usc"), (F.min, "lsc"), (F.sum, "tsc"))])


def error_of(mapq16: Column) -> Column:
    """The probability that a quality times 16 stands for."""
    return F.pow(F.lit(10.0), -mapq16 / F.lit(160.0))


def combined_error(error: Column) -> Column:
    """An aggregate: the chance that at least one of independent errors happens; exactly 1 where one is certain."""
    return F.when(F.max(error) >= 1, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.sum(F.when(error < 1, F.log1p(-error)))))
