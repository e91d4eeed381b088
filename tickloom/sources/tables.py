"""Table scans, CSV training rows and time slices for paged fetches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import contracts
from tickloom.functions.times import interval_seconds


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, contract: str | None = None) -> DataFrame:
    """Parquet scan with the contract's schema and only the wanted columns."""
    reader = spark.read if contract is None else spark.read.schema(contracts.schema(contract))
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int,
              **options: str) -> DataFrame:
    """Database scan split into ranges of `column`, one query per partition."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
        numPartitions=str(partitions), **options).load()


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV rows with a header and a fixed schema."""
    return spark.read.schema(contracts.schema("training_rows")).option("header", True) \
        .option("enforceSchema", False).csv(path)


def fetch_slices(wanted: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Time slices of at most `page_rows` bars between `start_at` and `end_at`.

    One row per (symbol, interval, slice); slices follow each other without a
    gap, the next starting one bar after the last of the page before.
    """
    step = interval_seconds("interval_code")
    page = step * page_rows
    first, last = F.unix_seconds("start_at"), F.unix_seconds("end_at")
    starts = F.when(first <= last, F.sequence(first, last, page)).otherwise(F.array().cast("array<bigint>"))
    return wanted.withColumns({"_step": step, "_from": F.explode(starts)}).select(
        "symbol", "interval_code",
        F.timestamp_seconds("_from").alias("slice_start"),
        F.least(F.timestamp_seconds(F.col("_from") + F.col("_step") * (page_rows - 1)), F.col("end_at")).alias("slice_end"))
