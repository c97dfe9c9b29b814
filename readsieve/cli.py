"""Command line: ``python -m readsieve.cli -i hits.m8.gz ...``"""

from __future__ import annotations

import argparse
import logging
import os
import re
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators.filters import parse_filters
from .operators.ingest import BIT_SCORE, E_VALUE
from .operators.resolve import ITERATIONS, SCALE
from .plans import pipeline
from .sources import output_names, read_alignments, read_mapping, write_tsv
from .storage import Workspace

log = logging.getLogger("readsieve")


def bounded(kind, low, high):
    """An argparse type: a number of this kind within bounds."""

    def parse(text: str):
        try:
            value = kind(float(text)) if kind is int and re.fullmatch(r"[-+0-9.eE]+", text) else kind(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{text} is not between {low} and {high}")
        return value

    return parse


def memory(text: str) -> str:
    """``<int>K``, M or G, as Spark writes it."""
    if not (found := re.fullmatch(r"([1-9][0-9]*)([KMG])", text)):
        raise argparse.ArgumentTypeError(f"{text!r} is not a whole number with K, M or G")
    return f"{found[1]}{found[2].lower()}"


def filter_list(text: str) -> dict[str, float]:
    try:
        return parse_filters(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("readsieve", description="Filter alignments, resolve reads with several hits, and report coverage.")
    p.add_argument("-i", "--input", required=True, help="headerless TSV of 14 or 17 columns, plain or .gz")
    p.add_argument("-t", "--threads", type=bounded(int, 1, 1000), default=1, help="local threads, if no master is set elsewhere")
    p.add_argument("-p", "--prefix", help="prefix of the outputs")
    p.add_argument("-s", "--scale", type=bounded(float, 0, 1), default=SCALE, help="a read's alignments below this share of its best one go")
    p.add_argument("--filters", type=filter_list, default={}, help="name=value,name=value")
    p.add_argument("-b", "--bitscore", type=bounded(int, 0, 1_000_000), default=BIT_SCORE)
    p.add_argument("-e", "--evalue", type=bounded(float, 0, 1_000_000), default=E_VALUE)
    p.add_argument("-n", "--n-iters", type=bounded(int, 1, 100_000), default=ITERATIONS)
    p.add_argument("-m", "--mapping-file", help="headerless file of two columns: reference, group")
    p.add_argument("--retain", type=bounded(float, 0, 1), help="share of each reference's alignments that goes on, by e-value")
    p.add_argument("--no-trim", dest="trim", action="store_false", help="count coverage at the ends of references")
    p.add_argument("--anvio", action="store_true", help="write the table for anvi'o (with a mapping)")
    p.add_argument("--annotation-source", default="unknown")
    p.add_argument("--max-memory", type=memory, help="memory of the driver, e.g. 8G; 80 %% of what is free by default")
    p.add_argument("--tmp-dir", help="folder for intermediate tables, shared by all executors")
    p.add_argument("--keep-duplicates", action="store_true", help="keep alignments that differ in the read only")
    p.add_argument("--parts", action="store_true", help="write folders of parts instead of single files")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def free_memory() -> str:
    """80 % of the memory that is free, as Spark writes it."""
    return f"{max(1024, int(0.8 * os.sysconf('SC_AVPHYS_PAGES') * os.sysconf('SC_PAGE_SIZE') / 2**20))}m"


def session(args: argparse.Namespace) -> SparkSession:
    if running := SparkSession.getActiveSession():
        if args.max_memory:
            log.warning("--max-memory is ignored: a session is running already")
        return running
    builder = SparkSession.builder.appName("readsieve").config("spark.sql.adaptive.enabled", "true")
    if "spark.master" not in SparkSession.builder._options:
        builder = builder.config("spark.master", f"local[{args.threads}]")
    return builder.config("spark.driver.memory", args.max_memory or free_memory()).getOrCreate()


def require(spark: SparkSession, path: str | None, what: str) -> None:
    """Ends with a message if there is no such path."""
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
            raise SystemExit(f"readsieve: {what} {path} does not exist")


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        parser().print_help()
        return 0
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO)
    spark = session(args)
    for path, what in ((args.input, "input"), (args.mapping_file, "mapping file"), (args.tmp_dir, "folder")):
        require(spark, path, what)
    rows = read_alignments(spark, args.input)
    mapping = read_mapping(spark, args.mapping_file) if args.mapping_file else None
    results = pipeline.run(
        rows,
        mapping,
        anvio=args.anvio,
        annotation_source=args.annotation_source,
        filters=args.filters,
        trim=args.trim,
        evalue=args.evalue,
        bitscore=args.bitscore,
        iterations=args.n_iters,
        scale=args.scale,
        keep_duplicates=args.keep_duplicates,
        retain=args.retain,
        work=Workspace(spark, "run", folder=args.tmp_dir),
    )
    log.info("%d reads, of them %d with one alignment and %d with more; %d alignments", *results.multiplicity.first())
    names = output_names(args.input, args.prefix)
    outputs = {
        "multimap": results.no_multimap,
        "coverage": results.cov_stats,
        "group_abundances": results.gene_abundances,
        "group_abundances_agg": results.group_abundances,
        "group_abundances_anvio": results.anvio,
    }
    for kind, df in outputs.items():
        if df is not None:
            write_tsv(df, names[kind], single_file=not args.parts)
            log.info("wrote %s", names[kind])
    return 0


if __name__ == "__main__":
    sys.exit(main())
