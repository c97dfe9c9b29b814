"""Writing results."""

from __future__ import annotations

import gzip
import logging
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace

log = logging.getLogger(__name__)
#: What a file system says that it can do.
CONCAT = "fs.capability.paths.concat"
#: Parts that one task reads in order without sorting; a plan names each of them.
MOST_PARTS = 500
# Output suffixes.
SUFFIXES = {
    "multimap": "_no-multimap.tsv.gz",
    "coverage": "_cov-stats.tsv.gz",
    "group_abundances": "_group-abundances.tsv.gz",
    "group_abundances_agg": "_group-abundances-agg.tsv.gz",
    "group_abundances_anvio": "_group-abundances-anvio.tsv.gz",
}


def output_names(input_path: str, prefix: str | None = None) -> dict[str, str]:
    """By kind of output: the prefix, or the input's name up to its first dot, and a suffix."""
    stem = prefix or os.path.basename(input_path.rstrip("/")).split(".")[0]
    return {kind: stem + suffix for kind, suffix in SUFFIXES.items()}


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """TSV with a header, gzipped if the path ends in .gz; missing values are empty.

    A folder of parts, each with the header. ``single_file``: one file of just this name, which is what
    downstream tools read.  Where the file system can join files (HDFS), all tasks write parts, which
    are joined as they are (gzip files are valid when joined).  Elsewhere all tasks compute and save the rows, and one task then
    writes them in order: large results are better left in parts.  No rows pass through the driver.  The
    file gets its name at the end, so if anything fails an earlier one stays as it was.
    """
    if not single_file:
        _writer(df, path, header=True).csv(path)
        return
    fs, target = _file_system(df.sparkSession, path)
    mark = uuid.uuid4().hex
    folder = target.suffix(f".{mark}.parts")
    try:
        whole = _joined(df, fs, path, folder) if fs.hasPathCapability(target.getParent() or target, CONCAT) else None
        if whole is None:
            log.info("%s: this file system can't join files, so one task writes all rows", path)
            whole = _by_one_task(df, fs, path, folder)
        _replace(fs, target, whole, target.suffix(f".{mark}.old"))
    finally:
        fs.delete(folder, True)


def _writer(df: DataFrame, path: str, header: bool):
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    writer = writer.option("nullValue", "").option("emptyValue", "").option("nanValue", "").option("quote", "")
    return writer.option("compression", "gzip" if path.endswith(".gz") else "none")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _parts(fs, folder) -> list:
    """The parts that have any bytes, in order."""
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()]
    return sorted(found, key=lambda p: p.getName())


def _joined(df: DataFrame, fs, path: str, folder):
    """The file, or None if it isn't the header and all parts: some file systems replace what they should add to."""
    _writer(df, path, header=False).csv(folder.toString())
    header = ("\t".join(df.columns) + "\n").encode()
    spark = df.sparkSession
    whole = spark._jvm.org.apache.hadoop.fs.Path(folder, "whole")
    parts = _parts(fs, folder)
    out = fs.create(whole, True)
    try:
        out.write(gzip.compress(header) if path.endswith(".gz") else header)
    finally:
        out.close()
    size = sum(fs.getFileStatus(p).getLen() for p in [whole, *parts])
    if parts:
        listed = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            listed[i] = part
        fs.concat(whole, listed)
    return whole if fs.getFileStatus(whole).getLen() == size else None


def _by_one_task(df: DataFrame, fs, path: str, folder):
    spark = df.sparkSession
    work = Workspace(spark, "output")
    number = "_" * (1 + max(map(len, df.columns), default=0))  # a name that no column has
    saved = work.save(df.withColumn(number, F.monotonically_increasing_id()))
    place = spark._jvm.org.apache.hadoop.fs.Path(saved._saved_at)
    parts = _parts(place.getFileSystem(spark._jsc.hadoopConfiguration()), place)
    if len(parts) <= MOST_PARTS:
        # the parts as one task reads them, one after the other: it holds no more for more rows
        in_order = reduce(DataFrame.union, (spark.read.schema(saved.schema).parquet(p.toString()) for p in parts)).coalesce(1)
    else:
        in_order = saved.coalesce(1).sortWithinPartitions(number)
    _writer(in_order.drop(number), path, header=True).csv(folder.toString())
    work.drop(saved)
    return _parts(fs, folder)[0]


def _replace(fs, target, whole, aside) -> None:
    """Give ``whole`` the name ``target``."""
    earlier = fs.exists(target)
    if earlier and not fs.rename(target, aside):
        raise OSError(f"{target} can't be replaced")
    done = False
    try:
        if not fs.rename(whole, target):
            raise OSError(f"{target} can't be written")
        done = True
    finally:
        if earlier and done:
            fs.delete(aside, True)
        elif earlier:
            fs.rename(aside, target)
