"""Registered queries: each operator over the adapter's alignments."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..operators import coverage, groups, stats
from ..operators.filters import apply_filters, on_references, parse_filters
from ..operators.ingest import analytic_columns, drop_duplicates, retain_by_evalue, threshold_filter, union_alignments
from ..operators.resolve import initial_weights, resolve, step
from ..schema import ALIGNMENT, ORDINAL
from ..sources import blocks, output_names, read_alignments, read_mapping, write_tsv
from ..storage import Workspace
from . import adapter, pipeline
from .oracle import DOUBLES

FILTERS = {"depthEvenness": 1.2, "breadth": 0.3}
ALL_FILTERS = {
    "avgAlnLength": 25,
    "nAlns": 3,
    "avgReadLength": 95,
    "avgIdentity": 90.5,
    "breadth": 0.2,
    "covMean": 0.25,
    "avgDepth": 1,
    "covStd": 0.3,
    "breadthExpectedRatio": 0.5,
    "depthEvenness": 2,
}
RETAINED = 0.4


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, sums of them to four, as in the SQL."""
    places = {**dict.fromkeys(DOUBLES, 6), "coverage_sum": 4}
    return df.select(*(F.round(c, places[c]).alias(c) if c in places and t == "double" else F.col(c) for c, t in df.dtypes))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_filter(adapter.alignments(spark, sf_dir))


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicates(_filtered(spark, sf_dir))


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without duplicates, saved; only the columns that statistics read."""
    work = Workspace(spark, "query")
    filtered = work.save(_filtered(spark, sf_dir), codec="zstd")
    return work.save(drop_duplicates(analytic_columns(filtered), work))


def _with_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    work = Workspace(spark, "query")
    unique = work.save(_unique(spark, sf_dir))
    return unique, work.save(apply_filters(stats.reference_stats(unique, work=work), FILTERS))


def _surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_references(*_with_stats(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _narrow(spark, sf_dir)
    return coverage.segments(unique, stats.alignment_stats(unique).select("subjectId", "L", "avg_alignment_length"))


def _run(spark: SparkSession, sf_dir: str, mapped: bool = False) -> pipeline.Results:
    mapping = adapter.mapping(spark, sf_dir) if mapped else None
    return pipeline.run(adapter.alignments(spark, sf_dir), mapping, anvio=mapped, filters=FILTERS)


def _step(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = Workspace(spark, "query").save(initial_weights(*_with_stats(spark, sf_dir)))
    return step(weighted).select("queryId", "subjectId", "p")


def _tsv(df: DataFrame, codec: str, sep: str = "\t") -> str:
    """A headerless file in the shared folder; its path."""
    path = f"{Workspace(df.sparkSession, 'files').root}/input"
    df.write.option("sep", sep).option("quote", "").option("compression", codec).csv(path)
    return path


def _wide(alignments: DataFrame) -> DataFrame:
    return alignments.withColumns({"cigar": F.concat(F.col("alnLength").cast("string"), F.lit("M")), "qaln": F.lit('AC"GT'), "taln": F.col("slen").cast("string")})


def _read_back(alignments: DataFrame, codec: str) -> DataFrame:
    return read_alignments(alignments.sparkSession, _tsv(alignments, codec)).drop(ORDINAL)


def _write_block_gzip(alignments: DataFrame) -> str:
    """Headerless files of block gzip in the shared folder, one for each partition; their folder."""
    folder = f"{Workspace(alignments.sparkSession, 'files').root}/input"

    def write(batches):
        system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.m8.gz"
        system.create_dir(path)
        part = f"{path}/_{name}.{task.taskAttemptId()}"  # an attempt writes a file of its own, and the name is given at the end
        with system.open_output_stream(part, compression=None) as out:
            for packed in blocks.members(("\n".join(b.column(0).to_pylist()) + "\n").encode() for b in batches if b.num_rows):
                out.write(packed)
        system.move(part, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    text = alignments.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in alignments.columns]))
    text.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _first_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of reads, so that the first of equal alignments is the one of the least read."""
    path = _tsv(threshold_filter(adapter.alignments(spark, sf_dir)).orderBy("queryId"), "gzip")
    return drop_duplicates(read_alignments(spark, path)).drop(ORDINAL)


def _mapping_back(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    return read_mapping(spark, _tsv(adapter.mapping(spark, sf_dir), "none", sep)).withColumnRenamed("group", "grp")


def _written(df: DataFrame, single_file: bool) -> DataFrame:
    """Written as TSV, packed, and read back."""
    path = f"{Workspace(df.sparkSession, 'files').root}/output.tsv.gz"
    write_tsv(df, path, single_file)
    return df.sparkSession.read.schema(df.schema).option("sep", "\t").option("header", True).csv(path)


def _command_line(spark: SparkSession, sf_dir: str, output: str, schema: str) -> DataFrame:
    """One of the outputs of a run from the command line, files in and files out.

    Of equal alignments the first in the input stays; in order of reads, that is the one of the least read, as in the SQL.
    """
    work = Workspace(spark, "files")
    hits = f"{work.root}/hits.m8.gz"
    adapter.alignments(spark, sf_dir).orderBy("queryId").write.option("sep", "\t").option("quote", "").option("compression", "gzip").csv(hits)
    groups_file = f"{work.root}/groups.tsv"
    adapter.mapping(spark, sf_dir).write.option("sep", "\t").option("quote", "").csv(groups_file)
    prefix = f"{work.root}/run"
    filters = ",".join(f"{name}={value}" for name, value in FILTERS.items())
    cli.main(["-i", hits, "-m", groups_file, "-p", prefix, "--filters", filters, "--anvio", "--annotation-source", "unknown", "--tmp-dir", work.root])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(output_names(hits, prefix)[output])


COV_SCHEMA = "depth_mean double, depth_std double, depth_evenness double, breadth double, n_alns long, avg_read_length double, stdev_read_length double, avg_alignment_length double, avg_identity double, stdev_identity double"
AGGREGATED_SCHEMA = "grp string, coverage_mean double, coverage_stdev double, coverage_median double, coverage_sum double, n_genes long, avg_read_length double, stdev_read_length double, avg_identity double, stdev_identity double"
ANVIO_SCHEMA = "gene_id string, enzyme_accession string, source string, coverage double, detection double"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "ingest_filter": _filtered,
        "dedup_alignments": _unique,
        "align_stats": lambda s, d: stats.alignment_stats(_narrow(s, d)),
        "coverage_segments": lambda s, d: _segments(s, d).select("subjectId", "pos", "next_pos", "depth"),
        "coverage_trimmed": lambda s, d: coverage.trimmed(_segments(s, d)).select("subjectId", "pos", "next_pos", "depth", "length"),
        "reference_stats": lambda s, d: stats.reference_stats(_narrow(s, d)),
        "reference_stats_filtered": lambda s, d: apply_filters(stats.reference_stats(_narrow(s, d)), FILTERS),
        "surviving_alignments": _surviving,
        "resolver_init": lambda s, d: initial_weights(*_with_stats(s, d)).select("queryId", "subjectId", "p"),
        "resolver_one_step": _step,
        "resolve_multimaps": lambda s, d: resolve(Workspace(s, "query").save(_surviving(s, d))),
        "rejoin_alignments": lambda s, d: pipeline.resolve_alignments(adapter.alignments(s, d), FILTERS).rejoined,
        "pipeline_cov_stats": lambda s, d: _run(s, d).cov_stats,
        "pipeline_no_multimap": lambda s, d: _run(s, d).no_multimap,
        "gene_abundances": lambda s, d: _run(s, d, True).gene_abundances,
        "group_abundances": lambda s, d: _run(s, d, True).group_abundances,
        "anvio_export": lambda s, d: _run(s, d, True).anvio,
        "read_multiplicity": lambda s, d: stats.read_multiplicity(_narrow(s, d)),
        "distinct_counts": lambda s, d: stats.distinct_counts(_narrow(s, d)),
        "stats_by_breadth": lambda s, d: stats.by_breadth(stats.reference_stats(_narrow(s, d))).select("subjectId", "breadth"),
        "evalue_retention": lambda s, d: retain_by_evalue(adapter.alignments(s, d), RETAINED),
        "union_alignments": lambda s, d: union_alignments([_unique(s, d), adapter.alignments(s, d)]).groupBy("subjectId").agg(F.count("*").alias("n")),
        "all_filters": lambda s, d: apply_filters(stats.reference_stats(_narrow(s, d)), ALL_FILTERS).select("subjectId"),
        "breadth_expected": lambda s, d: stats.with_breadth_expected(stats.reference_stats(_narrow(s, d))).select(
            "subjectId", "breadth", "mean_coverage", "breadth_expected", "breadth_expected_ratio"
        ),
        "read_plain": lambda s, d: _read_back(adapter.alignments(s, d), "none"),
        "read_gzip": lambda s, d: _read_back(adapter.alignments(s, d), "gzip"),
        "read_block_gzip": lambda s, d: read_alignments(s, _write_block_gzip(adapter.alignments(s, d))).drop(ORDINAL),
        "read_wide": lambda s, d: _read_back(_wide(adapter.alignments(s, d)), "gzip"),
        "dedup_from_files": _first_in_file,
        "read_mapping_tab": lambda s, d: _mapping_back(s, d, "\t"),
        "read_mapping_comma": lambda s, d: _mapping_back(s, d, ","),
        "write_parts": lambda s, d: _written(_run(s, d).cov_stats, single_file=False),
        "write_one_file": lambda s, d: _written(_run(s, d).cov_stats, single_file=True),
        "command_line_cov_stats": lambda s, d: _command_line(s, d, "coverage", f"reference string, {COV_SCHEMA}"),
        "command_line_no_multimap": lambda s, d: _command_line(s, d, "multimap", ALIGNMENT),
        "command_line_genes": lambda s, d: _command_line(s, d, "group_abundances", f"reference string, grp string, {COV_SCHEMA}"),
        "command_line_groups": lambda s, d: _command_line(s, d, "group_abundances_agg", AGGREGATED_SCHEMA),
        "command_line_anvio": lambda s, d: _command_line(s, d, "group_abundances_anvio", ANVIO_SCHEMA),
        "filters_from_text": lambda s, d: apply_filters(stats.reference_stats(_narrow(s, d)), parse_filters("breadth=0.25, nAlns=2,depthEvenness=1.5")).select("subjectId"),
    }
    return {name: (lambda s, d, f=f: _rounded(f(s, d))) for name, f in found.items()}
