"""Tables of a pipeline's stages that are rewritten whole or in part: written aside first, then swapped in.

A run that fails while it computes or writes leaves the old rows as they were.  The swap is two renames of folders; ``recover`` ends
one that was cut off between them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Folders:
    """Renames and deletions through the file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        return self.system.exists(self.make(path))

    def move(self, a: str, b: str) -> None:
        if not self.system.rename(self.make(a), self.make(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    def drop(self, path: str) -> None:
        self.system.delete(self.make(path), True)


def _write(df: DataFrame, path: str, kind: str, options: dict, by: list[str] | None = None) -> None:
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


#: Partitions whose files a task keeps open at once; rows of more than these are sorted by partition first, which spills.
OPEN_FILES = 16
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _unsorted(spark: SparkSession):
    """Partitioned writes in this block keep ``OPEN_FILES`` files open in a task and don't sort its rows."""
    before = spark.conf.get(_OPEN, None)
    spark.conf.set(_OPEN, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(_OPEN, before) if before is not None else spark.conf.unset(_OPEN)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write a Parquet table with a folder for each value of ``by``."""
    with _unsorted(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)


def replace(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, **options) -> None:
    """Put the rows of ``df`` in place of the table at ``path``, which ``df`` may read itself."""
    folders, aside = _Folders(df.sparkSession, path), f"{path}.new-{uuid.uuid4().hex}"
    recover(df.sparkSession, path)
    try:
        _write(df, aside, kind, options, by)
    except BaseException:
        folders.drop(aside)
        raise
    old = f"{path}.old"
    if folders.there(path):
        folders.move(path, old)
    folders.move(aside, path)
    folders.drop(old)


def recover(spark: SparkSession, path: str) -> None:
    """After a swap that was cut off: the old table comes back if the new one is not in place, else it goes."""
    folders, old = _Folders(spark, path), f"{path}.old"
    if folders.there(old):
        if folders.there(path):
            folders.drop(old)
        else:
            folders.move(old, path)


def replace_partitions(df: DataFrame, path: str, by: list[str], **options) -> None:
    """Put the rows of ``df`` in place of those partitions of a Parquet table that it has rows of; the others stay.

    The rows are written aside first, so ``df`` may read the table, and a failure in them touches nothing.  Spark then overwrites the partitions
    from the written rows, each moved in when all are ready.
    """
    spark = df.sparkSession
    folders, aside = _Folders(spark, path), f"{path}.part-{uuid.uuid4().hex}"
    try:
        df.write.parquet(aside)
        made = spark.read.schema(df.schema).parquet(aside)
        with _unsorted(spark):
            made.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy(*by).parquet(path)
    finally:
        folders.drop(aside)
