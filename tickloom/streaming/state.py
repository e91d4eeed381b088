"""Output of micro-batches as tables: one folder per batch, replaced when the batch is repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.tables import drop_path


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def save_batch(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write one micro-batch's output under its id; a repeated batch replaces it."""
    target = batch_folder(path, batch_id)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """Output of one micro-batch; nothing where there is none."""
    try:
        return spark.read.schema(schema).parquet(batch_folder(path, batch_id))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    if batch_id >= 0:
        drop_path(spark, batch_folder(path, batch_id))


def read_output(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields)).add("batch_id", "long")
    return spark.read.schema(full).parquet(path)


def newest_of_batches(spark: SparkSession, path: str, schema: StructType, key: str, upto: int) -> DataFrame:
    """The row of every key that the latest batch up to `upto` wrote for it."""
    rest = [c for c in schema.names if c != key]
    rows = read_output(spark, path, schema).where(F.col("batch_id") <= upto)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(
        *[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in schema.names])


def ensure_table(spark: SparkSession, path: str, schema: StructType, partition_by=()) -> None:
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partition_by).parquet(path)
