"""Abundances of groups of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .selection import quantiles


def join_mapping(cov_stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """(reference, group, ...statistics): one row per reference and group that it is in.

    Which side is broadcast, if any, is left to the planner: it knows the sizes.
    """
    return mapping.join(cov_stats, "reference").select(*mapping.columns, *(c for c in cov_stats.columns if c != "reference"))


def aggregate_groups(gene_abundances: DataFrame, group: str = "group", work: Workspace | None = None) -> DataFrame:
    """Per group: coverage (sample deviation, exact median), genes, and unweighted means of their statistics.

    A group may have any number of genes: no task holds its depths.
    """
    means = gene_abundances.groupBy(group).agg(
        F.avg("depth_mean").alias("coverage_mean"),
        F.stddev_samp("depth_mean").alias("coverage_stdev"),
        F.sum("depth_mean").alias("coverage_sum"),
        F.count("*").alias("n_genes"),
        F.avg("avg_read_length").alias("avg_read_length"),
        F.avg("stdev_read_length").alias("stdev_read_length"),
        F.avg("avg_identity").alias("avg_identity"),
        F.avg("stdev_identity").alias("stdev_identity"),
    )
    medians = quantiles(gene_abundances, [group], F.col("depth_mean"), 0.5, work).withColumnRenamed("quantile", "coverage_median")
    both = means.join(medians, means[group].eqNullSafe(medians[group]), "left").drop(medians[group])
    head = [group, "coverage_mean", "coverage_stdev", "coverage_median"]
    return both.select(*head, *(c for c in both.columns if c not in head))


def to_anvio(gene_abundances: DataFrame, annotation_source: str = "unknown", group: str = "group") -> DataFrame:
    """The table that anvi'o imports; every ``ko:`` in a group's name is left out."""
    return gene_abundances.select(
        F.col("reference").alias("gene_id"),
        F.replace(F.col(group), F.lit("ko:"), F.lit("")).alias("enzyme_accession"),
        F.lit(annotation_source).alias("source"),
        F.col("depth_mean").alias("coverage"),
        F.col("breadth").alias("detection"),
    )
