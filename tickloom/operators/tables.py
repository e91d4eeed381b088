"""Table maintenance: upserts, inserts, slice replacement, retention, keys.

The `merge_*` functions are DataFrame to DataFrame; `write_*` persist a result
as partitioned Parquet. A written table is never read and overwritten in one
plan: the merged rows are checkpointed in the shared folder first, then only
the partitions they touch are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import seconds_interval
from tickloom.operators.blocks import with_position
from tickloom.operators.tokens import earliest_per_key, latest_per_key
from tickloom.session import cut_lineage


def merge_latest(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: one row per key, the last by `order` wins on all other columns.

    Stored rows rank below every batch row. Copies of a key collapse on the map
    side, and applying a batch twice gives the same table.
    """
    rest = [c for c in batch.columns if c not in order]
    tagged = batch.select(*rest, F.lit(1).alias("_n"), *order).unionByName(
        current.withColumn("_n", F.lit(0)), allowMissingColumns=True)
    return latest_per_key(tagged, keys, ["_n", *order]).select(*current.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which NULL keys are equal, as they are in a GROUP BY."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how)


def fresh_rows(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored, first by `order`; a NULL key is a key like any other."""
    return join_null_safe(earliest_per_key(batch, keys, order), current, keys, "left_anti").select(*current.columns)


def merge_first(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: the stored rows and the `fresh_rows` of the batch."""
    return current.unionByName(fresh_rows(current, batch, keys, order))


def merge_columns(current: DataFrame, batch: DataFrame, keys: Sequence[str], replace: Sequence[str],
                  force: dict[str, Column]) -> DataFrame:
    """Upsert that replaces only some columns and forces others; new keys are inserted.

    `batch` holds one row per key with the columns `replace` plus those of new
    rows.
    """
    incoming = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c not in keys],
                            F.lit(True).alias("_hit"))
    joined = current.withColumn("_old", F.lit(True)).join(incoming, list(keys), "full_outer")
    hit = F.coalesce("_hit", F.lit(False))

    def value(c: str) -> Column:
        stored = F.col(c)
        if c in force:
            return F.when(hit, force[c]).otherwise(stored)
        if c not in batch.columns:
            return stored
        if c in replace:
            return F.when(hit, F.col(f"_new_{c}")).otherwise(stored)
        return F.when(F.col("_old").isNull(), F.col(f"_new_{c}")).otherwise(stored)

    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in current.columns])


def replace_slices(current: DataFrame, incoming: DataFrame, slice_keys: Sequence[str]) -> DataFrame:
    """All stored rows of the incoming slices go, the incoming rows come."""
    touched = incoming.select(*slice_keys).distinct()
    return current.join(touched, list(slice_keys), "left_anti").unionByName(incoming)


def replace_children(current: DataFrame, incoming: DataFrame, parent: str = "portfolio_id") -> DataFrame:
    """Positions of the incoming portfolios; rows without symbol or quantity are skipped.

    A portfolio whose incoming rows are all skipped ends up empty.
    """
    valid = incoming.where((F.length("symbol") > 0) & (F.col("quantity") != 0))
    touched = incoming.select(parent).distinct()
    return current.join(touched, parent, "left_anti").unionByName(valid)


def retain(df: DataFrame, ts: str, as_of: Column, days: int = 14) -> DataFrame:
    return df.where(F.col(ts) >= as_of.cast("timestamp") - seconds_interval(days * 86400))


def retain_table(spark: SparkSession, path: str, ts: str, cutoff: Column | str, day: str = "day") -> dict[str, int]:
    """Delete the rows of a stored table that are older than `cutoff`; returns the days dropped and rewritten.

    The table is partitioned by `day`, the date of `ts`. Whole days before the cutoff go as folders, the
    day on the boundary is rewritten without its older rows, files of other days are not touched. Rows
    without a time are not older than anything and stay. The boundary is complete in the shared folder
    before it replaces the stored one, and repeating the call changes nothing, so it may be run again
    after a failure.
    """
    limit = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff.cast("timestamp")
    instant = spark.range(1).select(F.date_format(limit, "yyyy-MM-dd").alias("d"), limit.cast("string").alias("t")).first()
    if instant["t"] is None:
        return {"dropped": 0, "rewritten": 0}
    days = [name.split("=", 1)[1] for name in folder_names(spark, path) if name.startswith(f"{day}=")]
    old = [d for d in days if d[:4].isdigit() and d < instant["d"]]
    stored = spark.read.parquet(path)
    boundary = stored.where(F.col(day) == F.lit(instant["d"]).cast("date"))
    kept = F.col(ts).cast("timestamp") >= F.lit(instant["t"]).cast("timestamp")
    rewritten = 0
    if instant["d"] in days and not boundary.where(~kept).isEmpty():
        left = cut_lineage(boundary.where(kept))
        if left.isEmpty():
            old.append(instant["d"])
        else:
            write_partitions(left, path, [day])
            rewritten = 1
    for d in old:
        drop_path(spark, f"{path}/{day}={d}")
    return {"dropped": len(old), "rewritten": rewritten}


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none where there is no such folder."""
    store, at = _hadoop(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads; nothing happens where there is none."""
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def toggle(df: DataFrame, flag: str, hit: Column) -> DataFrame:
    return df.withColumn(flag, F.when(hit, ~F.col(flag)).otherwise(F.col(flag)))


def get_or_create(dimension: DataFrame, names: DataFrame, name: str = "symbol", key: str = "id") -> DataFrame:
    """Dimension with a key for every name; new names are numbered after the largest key.

    Numbers come from counts of 4,096 hash blocks (by name inside a block), not
    from one global sort; they are dense and the same on every run.
    """
    fresh = names.select(name).where(F.length(name) > 0).distinct().join(dimension.select(name), name, "left_anti")
    placed = with_position(fresh, [], [name], F.substring(F.md5(F.col(name).cast("binary")), 1, 3))
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    return dimension.unionByName(placed.select((top + F.col("pos") + 1).alias(key), name), allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write Parquet; partitioned output is rebalanced so a large partition gets several files."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    write_table(df, path, partition_by, "append")


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in `df`."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*partition_by).parquet(path)


def touched_rows(spark: SparkSession, path: str, batch: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions a batch touches, those of NULL partitions included.

    Nothing is collected: the stored table meets the batch's distinct partition tuples. Where all values
    are there, a plain semi join lets Spark prune the partitions at run time; tuples with a NULL meet
    only the stored partitions that have one.
    """
    stored = spark.read.schema(batch.schema).parquet(path).select(*batch.columns)
    touched = batch.select(*partition_by).distinct()
    any_null = reduce(or_, [F.col(c).isNull() for c in partition_by])
    plain = stored.join(touched.where(~any_null), list(partition_by), "left_semi").select(*batch.columns)
    return plain.unionByName(join_null_safe(stored.where(any_null), touched.where(any_null), partition_by, "left_semi"))


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
                 order: Sequence[str] = (), ignore_existing: bool = False) -> None:
    """Upsert (or insert-or-ignore) a batch into a partitioned table.

    The partition columns must follow from the key. The batch is computed once. Insert-or-ignore only
    appends the rows that are new. Safe to repeat: merged partitions are complete before any stored one
    is replaced, and rows appended before are stored keys the next time.
    """
    batch = cut_lineage(batch)
    shaped = batch.select(*[c for c in batch.columns if c not in order])
    stored = touched_rows(spark, path, shaped, partition_by)
    if ignore_existing:
        append_table(cut_lineage(fresh_rows(stored, batch, keys, order)), path, partition_by)
    else:
        write_partitions(cut_lineage(merge_latest(stored, batch, keys, order)), path, partition_by)
