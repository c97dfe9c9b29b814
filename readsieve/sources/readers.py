"""Reading alignment and mapping files.

Paths go to Spark's readers, so any store that Spark reads will do; only block gzip is read in another way where it can be.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BY_ARITY, MAPPING, ORDINAL
from . import blocks

# The first bytes of compressed files.
MAGIC = {"gz": b"\x1f\x8b\x08", "bz2": b"BZh", "zip": b"PK\x03\x04"}
#: Delimiters that a mapping may have.
DELIMITERS = "\t,;| "
#: Bytes of packed input for one partition, and the least of block gzip.
PACKED_PARTITION, LEAST_PARTITION = 32_000_000, 1_000_000
#: How alignment files are parsed.
TSV_OPTIONS = {"sep": "\t", "mode": "FAILFAST", "quote": ""}
#: A row's ordinal has its place in the file in so many bits, and above these the file's rank by name.
PLACE_BITS = 43
#: Files whose ranks are broadcast.
MOST_BROADCAST = 100_000


def compression(spark: SparkSession, path: str) -> str:
    """gz, bz2, zip or plain, by the first bytes of the (first) file."""
    stream = next(iter(_files(spark, path)))
    fs = stream.getFileSystem(spark._jsc.hadoopConfiguration())
    opened = fs.open(stream)
    try:
        head = bytes(b for b in (opened.read() for _ in range(4)) if b >= 0)
    finally:
        opened.close()
    return next((kind for kind, magic in MAGIC.items() if head.startswith(magic)), "plain")


def _files(spark: SparkSession, path: str):
    return [s.getPath() for s in _statuses(spark, path)]


def _statuses(spark: SparkSession, path: str) -> list:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    if not found:
        raise FileNotFoundError(path)
    files = []
    for status in found:
        if status.isDirectory():
            files += [s for s in fs.listStatus(status.getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        else:
            files.append(status)
    if not files:
        raise ValueError(f"{path}: no files")
    return files


def arity(spark: SparkSession, path: str) -> int:
    """Columns of the first line."""
    first = spark.read.text(path).limit(1).select(F.size(F.split("value", "\t")).alias("n")).first()
    return first["n"] if first else 0


def read_alignments(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A headerless TSV (plain or .gz) of 14 or 17 columns, with each row's place in ``ordinal``.

    Malformed rows are errors.  Files of block gzip are read by ranges.  Any other .gz file is read by one task, which deals its
    rows out to ``partitions`` others; by default to as many as its size asks for, and to all cores at least.
    The ordinal is a number, by file name, then by position in the file, so it does not depend on the order
    in which tasks run.  Up to a million files of up to 8 TB have room in it.  Empty input, and inputs of another arity, are errors.
    """
    kind = compression(spark, path)
    if kind in ("bz2", "zip"):
        raise ValueError(f"{path}: {kind} is not supported; use plain text or gzip")
    if kind == "gz" and not all(p.getName().endswith(".gz") for p in _files(spark, path)):
        raise ValueError(f"{path}: gzip files must end in .gz")
    n = arity(spark, path)
    if n not in BY_ARITY:
        raise ValueError(f"{path}: expected {' or '.join(map(str, BY_ARITY))} columns, found {n}")
    if kind == "gz":
        rows = _by_ranges(spark, path, BY_ARITY[n])
        if rows is not None:
            return rows.repartition(partitions) if partitions else rows
    rows = _with_ordinal(spark.read.schema(BY_ARITY[n]).options(**TSV_OPTIONS).csv(path))
    if kind == "gz" and not partitions:
        sizes = [s.getLen() for s in _statuses(spark, path)]
        wanted = max(spark.sparkContext.defaultParallelism, -(-sum(sizes) // PACKED_PARTITION))
        partitions = wanted if wanted > len(sizes) else None
    return rows.repartition(partitions) if partitions else rows


def _by_ranges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Rows of files of block gzip; null if they can't be read so."""
    files = sorted((re.sub("^file:/+", "file:///", s.getPath().toString()), s.getLen()) for s in _statuses(spark, path) if s.getLen())
    share = -(-sum(size for _, size in files) // spark.sparkContext.defaultParallelism)
    lines = blocks.read_lines(spark, files, max(LEAST_PARTITION, min(PACKED_PARTITION, share)))
    if lines is None:
        return None
    columns = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema)
    return lines.select(F.from_csv("value", columns, TSV_OPTIONS).alias("row"), F.col("place").alias(ORDINAL)).select("row.*", ORDINAL)


def _with_ordinal(rows: DataFrame) -> DataFrame:
    """Adds each row's place.

    Within a file that is the offset of the row's block, and its number within the task's input: a block that another
    one of the same file follows is as large as a task's whole input may be, and a row has some bytes, so numbers never reach the next block.
    """
    path, columns = "_path", rows.columns
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    plain = lambda p: F.regexp_replace(p, "^file:/+", "file:/")  # noqa: E731  Spark writes it in two ways
    placed = rows.select("*", plain(F.col("_metadata.file_path")).alias(path), (F.col("_metadata.file_block_start") + number).alias(ORDINAL))
    files = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())
    if len(files) == 1:
        return placed.select(*columns, ORDINAL)
    ranks = rows.sparkSession.createDataFrame(list(enumerate(files)), f"_rank long, {path} string")
    # the planner doesn't know how small ranks are, and a join by path would give each file to one task
    ranks = F.broadcast(ranks) if len(files) <= MOST_BROADCAST else ranks
    return placed.join(ranks, path).select(*columns, F.shiftleft("_rank", PLACE_BITS).bitwiseOR(F.col(ORDINAL)).alias(ORDINAL))


def delimiter(spark: SparkSession, path: str) -> str:
    """What cuts the first line into two columns."""
    _statuses(spark, path)
    first = spark.read.text(path).limit(1).first()
    line = first["value"] if first else ""
    for sep in DELIMITERS:
        if len(line.split(sep)) == 2:
            return sep
    raise ValueError(f"{path}: expected two columns, found {line!r}")


def read_mapping(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A headerless file of references and their groups; a reference may be in several.

    The delimiter is found out by the first line unless it is given.
    """
    sep = sep or delimiter(spark, path)
    return spark.read.schema(MAPPING).option("sep", sep).option("quote", "").csv(path)
