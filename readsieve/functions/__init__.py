"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def content_hash(columns: list[str]) -> list[Column]:
    """128 bits by which equal rows are known, as two columns. Nulls leave a hash as it is, so where they are goes in as well."""
    nulls = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*columns, *nulls).alias("hash_a"), F.xxhash64(F.lit("b"), *columns, *nulls).alias("hash_b")]


def breadth_expected(depth_mean: Column) -> Column:
    """The breadth that random placement would give at a mean depth."""
    return 1 - F.exp(-depth_mean)


def trim_length(avg_alignment_length: Column, length: Column) -> Column:
    """Positions left out at each end; none if that would leave nothing."""
    t = F.ceil(avg_alignment_length) + 10
    return F.when(t >= length, F.lit(0)).otherwise(t).cast("long")
