"""Folders, staged tables and files shared by the operators.

Rules that hold for every operator here: only the named columns are read, so further columns of any
name do no harm and are not returned; a null text counts as an empty one unless a docstring says
otherwise; rows that repeat give one result row each; an empty table gives an empty result with the
same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

#: Columns of the table `documents`.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows, so that no task holds its whole output."""
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, type=field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, for tasks that write files which are not tables."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)


class ArrivingFile:
    """A file that is visible under its name only once it is whole: a lost or repeated task leaves no half."""

    def __init__(self, uri: str):
        self.store, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex[:8]}.tmp"

    def __enter__(self):
        self.sink = self.store.open_output_stream(self.temporary)
        return self.sink

    def __exit__(self, kind, value, trace) -> None:
        self.sink.close()
        if kind is None:
            self.store.move(self.temporary, self.path)
        else:
            self.store.delete_file(self.temporary)
