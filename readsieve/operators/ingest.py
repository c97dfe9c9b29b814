"""Threshold filter and removal of duplicate alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content_hash
from ..schema import ANALYTIC, ORDINAL
from ..storage import Workspace
from . import membership
from .selection import quantiles

E_VALUE, BIT_SCORE = 1e-10, 60
#: The columns of ``content_hash``.
HASHES = ["hash_a", "hash_b"]


def threshold_filter(alignments: DataFrame, evalue: float = E_VALUE, bitscore: float = BIT_SCORE) -> DataFrame:
    """Both bounds count as kept; rows without a value go."""
    return alignments.where((F.col("eVal") <= evalue) & (F.col("bitScore") >= bitscore))


def analytic_columns(alignments: DataFrame) -> DataFrame:
    """The columns that the analysis reads, with a 128-bit hash of all columns but queryId."""
    content = [c for c in alignments.columns if c not in ("queryId", ORDINAL)]
    return alignments.select(*ANALYTIC, *content_hash(content), *[c for c in alignments.columns if c == ORDINAL])


def drop_duplicates(alignments: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Of rows that agree in all but queryId, the first by ``ordinal``; without that, the least queryId.

    An aggregate, so equal rows are combined before the shuffle however many there are.  An ordinal is a number that
    no other row has: its minimum needs no sorting, and tells the row whose queryId is fetched.

    ``work``: for a saved table, which is read three times then.  Only 128-bit hashes of the rows are counted, and rows whose hash
    may be among those that occur more than once (a Bloom filter tells) go to the aggregate; all others stay where they are.
    """
    content = [c for c in alignments.columns if c not in ("queryId", ORDINAL)]
    if work is not None:
        alone, alignments = _told_apart(alignments, content, work)
        if alone is not None:
            return alone.unionByName(drop_duplicates(alignments))
    if ORDINAL not in alignments.columns:
        return alignments.groupBy(*content).agg(F.min("queryId").alias("queryId")).select(*alignments.columns)
    first = alignments.groupBy(*content).agg(F.min(ORDINAL).alias(ORDINAL))
    return first.join(alignments.select(ORDINAL, "queryId"), ORDINAL).select(*alignments.columns)


def _told_apart(alignments: DataFrame, content: list[str], work: Workspace) -> tuple[DataFrame | None, DataFrame]:
    """Rows that no other row agrees with, and the rest, of which nearly all have such rows; (None, all rows) if that would not pay."""
    hashes = [F.col(c) for c in HASHES] if set(HASHES) <= set(content) else content_hash(content)
    counted = alignments.select(*hashes).groupBy(*HASHES).agg(F.count("*").alias("n")).where("n > 1")
    copied = work.save(counted)
    n, copies = copied.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n > membership.MOST_KEYS or copies > membership.MOST_SHARE * alignments.count():
        return None, alignments
    hashed = alignments if set(HASHES) <= set(content) else alignments.select("*", *hashes)
    marked = membership.met(hashed, copied.select(*HASHES), n, work)
    return tuple(marked.where(F.col(membership.MET) == same).select(*alignments.columns) for same in (False, True))


def retain_by_evalue(alignments: DataFrame, share: float, work: Workspace | None = None) -> DataFrame:
    """Per reference, the alignments with the best e-values: those whose -log10 is at least the (1-share) quantile.

    Ties at the quantile all stay, so at least ``share`` of a reference's alignments do. An e-value
    of 0 counts as 1e-300. A reference may have any number of alignments: no task holds its e-values.
    """
    strength = -F.log10(F.greatest(F.col("eVal"), F.lit(1e-300)))
    bound = quantiles(alignments, ["subjectId"], strength, 1 - share, work)
    # the quantile is interpolated between two values, so equal values may differ in the last place
    return alignments.join(bound, "subjectId").where(strength >= F.col("quantile") - 1e-9).select(*alignments.columns)


def union_alignments(tables: list[DataFrame]) -> DataFrame:
    """All rows of several tables, with the columns of the first in its order."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first
