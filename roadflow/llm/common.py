"""Shared helpers: scratch tables in the cluster's shared folder, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.scratch import shared_dir, write_once
from roadflow.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one of the test tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        out = write_once(df, path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session with some settings, for the jobs that run inside; afterwards with its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns never clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str, *args) -> DataFrame:
    """``mapInArrow`` with a function that yields whole output batches for each Arrow batch."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch, *args)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, fn: Callable[..., list], fields: str, keep: list[str], *args) -> DataFrame:
    """The columns ``keep`` of every row, and those that ``fn(batch, *args)`` returns for them (``fields``: their DDL); see ``kept_names``."""
    ship(df.sparkSession)
    added = T._parse_datatype_string(fields)
    names = kept_names(keep, fields)
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep)] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + list(fn(batch, *args)), [*names, *added.names])

    return df.mapInArrow(run, schema)


def kept_names(keep: list[str], fields: str) -> list[str]:
    """The names under which the columns ``keep`` are returned: one that an output column has becomes ``kept_<name>``."""
    taken = set(T._parse_datatype_string(fields).names)
    return [f"kept_{c}" if c in taken else c for c in keep]


def by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes each (one row at least)."""
    return by_size((n or 0 for n in pc.binary_length(column).to_pylist()), limit)


def by_size(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``limit`` at most (one of them at least)."""
    start = total = i = 0
    for i, n in enumerate(sizes, 1):
        if i - 1 > start and total + n > limit:
            yield start, i - 1
            start, total = i - 1, 0
        total += n
    if i > start:
        yield start, i
