"""Exact quantiles of groups of any size.

An aggregate that holds a group's values in one buffer does for groups of up to ``GATHERED`` values.  In larger
ones values are selected by their digits: a double's 64 bits, put in the order of the values, are four
digits of 16 bits.  Counting a group's values by their first digit tells the digit of the value of
the wanted rank, and its rank among the values with that digit; these alone go on to the next digit.

Counts are plain aggregates, combined before the shuffle.  A group has at most 65,536 counts for
each wanted rank, however many values it has, and no task ever has a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

#: Values of a group that one buffer may hold.
GATHERED = 100_000
DIGIT_BITS, DIGITS = 16, 4
_MANTISSA, _LEAST_NORMAL = 2.0**52, 2.0**-1022
_INFINITE = 2047 << 52


def ordered_bits(x: Column) -> Column:
    """A long for each double, in the order of the values: its bits as a magnitude, with its sign. Both zeros are 0, NaN comes last."""
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole numbers
    guess = F.floor(F.log2(a)).cast("int")
    e = guess + F.when(power(guess + 1) <= a, 1).otherwise(0) - F.when(power(guess) > a, 1).otherwise(0)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((a * power(-e) - 1) * _MANTISSA).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(_INFINITE)).when(a < _LEAST_NORMAL, tiny).otherwise(normal)
    return F.when(F.isnan(x), F.lit(_INFINITE + 1)).when(x < 0, -bits).otherwise(bits)


def _digit(k: int) -> Column:
    return F.shiftrightunsigned("bits", DIGIT_BITS * (DIGITS - 1 - k)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def _prefix(k: int) -> Column:
    """The digits before the k-th."""
    return F.shiftrightunsigned("bits", DIGIT_BITS * (DIGITS - k)) if k else F.lit(0).cast("long")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Join condition under which nulls are equal."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _matched(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both, which come once; nulls are equal."""
    if how in ("left_semi", "left_anti"):
        return left.join(right, _same(left, right, columns), how)
    return left.join(right, _same(left, right, columns), how).select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in columns))


def select_by_digits(values: DataFrame, keys: list[str], targets: DataFrame, work: Workspace) -> DataFrame:
    """targets (keys, side, rank), ranks from 0 on, with ``x``: the value of that rank among those of the keys in values (keys, x)."""
    top = F.lit(-(1 << 63))  # unsigned order
    remaining = values.select(*keys, "x", ordered_bits(F.col("x")).bitwiseXOR(top).alias("bits"))
    targets = targets.withColumn("prefix", F.lit(0).cast("long"))
    by = [*keys, "prefix"]
    upto = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(DIGITS):
        counts = remaining.groupBy(*keys, _prefix(k).alias("prefix"), _digit(k).alias("digit")).agg(F.count("*").alias("n"), F.min("x").alias("x"))
        counts = counts.withColumn("after", F.sum("n").over(upto))
        wanted = _matched(targets.drop("x"), counts, by)
        wanted = wanted.where((F.col("rank") < F.col("after")) & (F.col("rank") >= F.col("after") - F.col("n")))
        prefix = F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit").cast("long"))
        before, targets = targets, work.save(wanted.select(*keys, "side", (F.col("rank") - F.col("after") + F.col("n")).alias("rank"), prefix.alias("prefix"), "x"))
        if k:
            work.drop(before)
        if k < DIGITS - 1:
            used = remaining
            candidates = remaining.withColumn("prefix", _prefix(k + 1))
            remaining = work.save(_matched(candidates, targets.select(*by).distinct(), by, "left_semi").drop("prefix"))
            if k:
                work.drop(used)
    return targets.select(*keys, "side", "x")


def quantiles(rows: DataFrame, keys: list[str], value: Column, share: float, work: Workspace | None = None) -> DataFrame:
    """(keys, quantile): the value at ``share`` of the way through each group's values, interpolated between two of them.

    Missing values don't count; groups without any value are left out. Missing keys are a group.
    """
    work = work or Workspace(rows.sparkSession, "quantiles")
    values = rows.select(*keys, value.cast("double").alias("x")).where("x is not null")
    sizes = work.save(values.groupBy(*keys).agg(F.count("*").alias("size")))
    large = sizes.where(F.col("size") > GATHERED)
    buffered = lambda df: df.groupBy(*keys).agg(F.percentile("x", F.lit(share)).alias("quantile"))
    if large.isEmpty():
        return buffered(values)
    usual = buffered(_matched(values, large.select(*keys), keys, "left_anti"))
    place = (F.col("size") - 1) * F.lit(float(share))
    ends = F.array(F.struct(F.lit("low").alias("side"), F.floor(place).alias("rank")), F.struct(F.lit("high").alias("side"), F.ceil(place).alias("rank")))
    targets = large.select(*keys, F.inline(ends))
    found = select_by_digits(_matched(values, large.select(*keys), keys, "left_semi"), keys, targets, work)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("x"))).alias(side)
    both = _matched(found.groupBy(*keys).agg(of("low"), of("high")), large, keys)
    part = place - F.floor(place)
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - part) + F.col("high") * part)
    return usual.unionByName(both.select(*keys, between.alias("quantile")))
