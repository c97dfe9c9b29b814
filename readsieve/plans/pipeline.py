"""The whole run: ingest, statistics, filter, resolve, statistics again, outputs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content_hash
from ..operators.filters import apply_filters, on_references, validate_filters
from ..operators.groups import aggregate_groups, join_mapping, to_anvio
from ..operators.ingest import BIT_SCORE, E_VALUE, analytic_columns, drop_duplicates, retain_by_evalue, threshold_filter
from ..operators.membership import may_be_among
from ..operators.resolve import ITERATIONS, SCALE, initial_weights, resolve
from ..operators.stats import read_multiplicity, reference_stats
from ..schema import COV_STATS, ORDINAL
from ..storage import Workspace


class Results(NamedTuple):
    cov_stats: DataFrame
    no_multimap: DataFrame
    gene_abundances: DataFrame | None = None
    group_abundances: DataFrame | None = None
    anvio: DataFrame | None = None
    multiplicity: DataFrame | None = None


def cov_stats(stats: DataFrame) -> DataFrame:
    """Statistics under their output names."""
    return stats.select(*(F.col(column).alias(name) for name, column in COV_STATS.items()))


class Resolved(NamedTuple):
    """Saved tables between the resolver and the outputs."""

    filtered: DataFrame
    first_stats: DataFrame
    surviving: DataFrame
    resolved: DataFrame
    rejoined: DataFrame
    unique: DataFrame


def resolve_alignments(
    alignments: DataFrame,
    filters: dict | None = None,
    evalue: float = E_VALUE,
    bitscore: float = BIT_SCORE,
    iterations: int = ITERATIONS,
    scale: float = SCALE,
    trim: bool = True,
    keep_duplicates: bool = False,
    retain: float | None = None,
    work: Workspace | None = None,
) -> Resolved:
    """Everything up to the second pass of statistics.

    Wide columns are hashed and not moved until the survivors are joined back; that join is on
    (queryId, hash of all other columns), so exact repeats of a row come back.  A Bloom filter of the survivors
    stands before it, so wide rows that won't come back are not moved.  ``retain``: of each
    reference only this share of alignments goes on, those with the best e-values.
    """
    work = work or Workspace(alignments.sparkSession, "run")
    filters = validate_filters(filters or {})
    filtered = threshold_filter(alignments, evalue, bitscore)
    filtered = work.save(filtered, codec="zstd")
    if retain is not None:
        every, filtered = filtered, work.save(retain_by_evalue(filtered, retain, work), codec="zstd")
        work.drop(every)
    narrow = analytic_columns(filtered)
    unique = narrow if keep_duplicates else drop_duplicates(narrow, work)
    # within a read 64 bits tell rows apart: 10,000 of them share a hash once in 3e11 reads
    unique = work.save(unique.drop(ORDINAL, "hash_b"))
    first = apply_filters(reference_stats(unique, trim, work), filters)
    first = work.save(first)
    # what the resolver reads, and the keys by which the survivors' rows are found again
    surviving = work.save(initial_weights(unique.select("queryId", "subjectId", "bitScore", "slen", "hash_a"), first).drop("subjectId", "bitScore"))
    resolved = resolve(surviving, iterations, scale, work)
    content = [c for c in filtered.columns if c not in ("queryId", ORDINAL)]
    keys = ["queryId", "hash_a"]
    hashed = filtered.select("*", content_hash(content)[0])
    survivors = resolved.select(*keys)
    near = may_be_among(hashed, survivors, work)
    # not a semi join, which the optimizer would move to before the filter
    rejoined = near.join(survivors.distinct(), keys).select(*[c for c in filtered.columns if c != ORDINAL])
    return Resolved(filtered, first, surviving.drop("p"), resolved, work.save(rejoined), unique)


def run(
    alignments: DataFrame,
    mapping: DataFrame | None = None,
    anvio: bool = False,
    annotation_source: str = "unknown",
    filters: dict | None = None,
    trim: bool = True,
    work: Workspace | None = None,
    **options,
) -> Results:
    """All outputs as DataFrames. Empty stages give empty outputs; a mapping without matches gives no group outputs."""
    work = work or Workspace(alignments.sparkSession, "run")
    steps = resolve_alignments(alignments, filters=filters, trim=trim, work=work, **options)
    rejoined = steps.rejoined
    second = work.save(apply_filters(reference_stats(rejoined, trim, work), filters))
    results = Results(cov_stats(second), on_references(rejoined, second), multiplicity=read_multiplicity(steps.unique))
    if mapping is None:
        return results
    genes = work.save(join_mapping(results.cov_stats, mapping))
    if not genes.limit(1).count():
        return results
    group = mapping.columns[1]
    return results._replace(
        gene_abundances=genes,
        group_abundances=aggregate_groups(genes, group, work),
        anvio=to_anvio(genes, annotation_source, group) if anvio else None,
    )
