"""Statistics of references: one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import breadth_expected, ratio_or_zero
from ..storage import Workspace
from .coverage import segments, trimmed

ALIGNMENT_STATS = [
    "avg_alignment_length",
    "num_alignments",
    "avg_read_length",
    "std_read_length",
    "avg_identity",
    "std_identity",
    "std_alignment_length",
]


def alignment_stats(alignments: DataFrame) -> DataFrame:
    """Per reference: counts, lengths and identities (population deviations), and its length ``L``."""
    return alignments.groupBy("subjectId").agg(
        F.max("slen").alias("L"),
        F.avg("alnLength").alias("avg_alignment_length"),
        F.count("*").alias("num_alignments"),
        F.avg("qlen").alias("avg_read_length"),
        F.stddev_pop("qlen").alias("std_read_length"),
        F.avg("percIdentity").alias("avg_identity"),
        F.stddev_pop("percIdentity").alias("std_identity"),
        F.stddev_pop("alnLength").alias("std_alignment_length"),
    )


def reference_stats(alignments: DataFrame, trim: bool = True, work: Workspace | None = None) -> DataFrame:
    """Alignment and coverage statistics.

    avg_depth is over covered positions, mean_coverage and std_coverage over all; breadth divides by
    the untrimmed length.  depth_evenness is std_coverage by mean_coverage, and null without coverage.

    The alignment statistics travel with the segments, so nothing is computed or joined twice, and
    everything after the two aggregates by reference stays in the partitions of subjectId, unless
    references are so long that their depths are added up in blocks.
    """
    own = alignment_stats(alignments)
    c = F.col
    rows = trimmed(segments(alignments, own, keep_empty=True, work=work), trim).groupBy(*own.columns).agg(
        F.sum(F.when(c("depth") != 0, c("length")).otherwise(0)).alias("covered"),
        F.sum(c("depth") * c("length")).alias("total"),
        F.sum((c("depth") * c("depth") * c("length")).cast("double")).alias("squares"),
    )
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    rows = rows.withColumn("mean_coverage", F.try_divide(zero("total"), c("L")))
    rows = rows.withColumn("std_coverage", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(zero("squares"), c("L")) - c("mean_coverage") * c("mean_coverage"))))
    return rows.select(
        "subjectId",
        *(x for x in ALIGNMENT_STATS if x != "std_alignment_length"),
        zero("covered").alias("total_covered_bases"),
        zero("total").alias("total_depth"),
        c("L").alias("subject_length"),
        F.try_divide(zero("covered"), c("L")).alias("breadth"),
        ratio_or_zero(zero("total"), zero("covered")).alias("avg_depth"),
        "mean_coverage",
        "std_coverage",
        F.when(c("mean_coverage") > 0, c("std_coverage") / c("mean_coverage")).alias("depth_evenness"),
    )


def with_breadth_expected(stats: DataFrame) -> DataFrame:
    """Adds breadth_expected and breadth_expected_ratio (null where nothing is expected)."""
    expected = breadth_expected(F.col("mean_coverage"))
    return stats.withColumn("breadth_expected", expected).withColumn(
        "breadth_expected_ratio", F.when(F.col("breadth_expected") > 0, F.col("breadth") / F.col("breadth_expected"))
    )


def read_multiplicity(alignments: DataFrame) -> DataFrame:
    """One row: reads, those with one alignment, those with more, and alignments."""
    per_read = alignments.groupBy("queryId").agg(F.count("*").alias("n"))
    return per_read.agg(
        F.count("*").alias("n_reads"),
        F.count_if(F.col("n") == 1).alias("unique_reads"),
        F.count_if(F.col("n") > 1).alias("multi_reads"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_alignments"),
    )


def distinct_counts(alignments: DataFrame) -> DataFrame:
    """One row: distinct reads and references."""
    return alignments.agg(F.countDistinct("queryId").alias("n_reads"), F.countDistinct("subjectId").alias("n_references"))


def by_breadth(stats: DataFrame) -> DataFrame:
    """Statistics in ascending order of breadth, then of reference."""
    return stats.orderBy("breadth", "subjectId")
