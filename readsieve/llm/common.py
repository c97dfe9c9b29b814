"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a function gets together. Documents have kilobytes each, and Spark's batches 10,000 rows.
BATCH_ROWS = 1000
#: For tables that are saved, batches between the JVM and Python are made so small to begin with.
LONG_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches cut for long rows; the session's settings stay as they are."""
    names = df.columns
    if any("." in c for c in names):  # mapInArrow takes a dot for access to a field
        df = df.toDF(*(free_name(df, f"_{i}") if "." in c else c for i, c in enumerate(names)))

    def cut(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS).rename_columns(names)

    return df.mapInArrow(lambda batches: function(cut(batches)), schema)


def let(value, body):
    """``body(value)``, with the value computed once (and what it gives copied once). Both are columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def own_columns(docs: DataFrame) -> list:
    """The table's columns; names may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def numbered(docs: DataFrame, work: Workspace) -> tuple[DataFrame, list[str]]:
    """The documents with columns that number their rows, the same at each reading, and these columns' names.

    Rows of Parquet files are known by file and place; what comes of a plan is saved first.
    """
    file, row = free_name(docs, "_file"), free_name(docs, "_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select(*own_columns(docs), F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), [file, row]
        except AnalysisException:  # another kind of source
            pass
    return work.save(docs.select(*own_columns(docs), F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(row))), [file, row]


def without_rows(docs: DataFrame, lost, work: Workspace) -> DataFrame:
    """The documents less some rows, which ``lost(file, row, text)`` finds; it keeps the first two columns.

    Only the numbers of the lost rows are saved; the texts are read once more instead of being moved.
    """
    known, (file, row) = numbered(docs, work)
    gone = lost(known.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("text").cast("string").alias("text")))
    gone = work.save(gone.select(F.col("file").alias(file), F.col("row").alias(row)).distinct())
    return known.join(gone, [file, row], "left_anti").select(*own_columns(docs))


def id_and_text(docs: DataFrame, *more) -> DataFrame:
    """doc_id as long, text as string, and other columns between them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def text_bytes(column):
    """The UTF-8 bytes of an Arrow string column as a list; null is None."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(data: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: ``bytes.split`` cuts at just these six bytes."""
    return data.split() if data else []
