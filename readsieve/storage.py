"""Intermediate tables in the folder that the whole cluster shares.

Executors come and go, so a step that must not be computed twice is written as Parquet to
``spark.checkpoint.dir``.  The folder is read from the session.  Where that names none, a folder of
this machine is used if all executors are on it (``local``), and else it is an error: tables in
it would be lost with their executors, or be torn.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED_DIR = "/tmp/checkpoints"
#: Once a table is saved, the shuffle files of its plan are of no more use.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default where that is not set and nothing but this machine takes part."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED_DIR).rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a while; the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Workspace:
    """Tables of one run, in a folder of their own; the JVM deletes what is left when it ends.

    ``conf``: settings under which tables are written. ``folder``: where, instead of the session's folder.
    """

    def __init__(self, spark: SparkSession, name: str, conf: dict[str, str] | None = None, folder: str | None = None):
        self.spark, self.conf = spark, CLEAN_UP | (conf or {})
        self.root = f"{folder.rstrip('/') if folder else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here."""
        self._count += 1
        where = f"{self.root}/{self._count:03d}"
        schema = df.schema
        with settings(self.spark, self.conf):
            df.write.option("compression", codec).parquet(where)
        saved = self.spark.read.schema(schema).parquet(where)
        saved._saved_at = where
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self._path(saved._saved_at)
        self._fs(path).delete(path, True)
