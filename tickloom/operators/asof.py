"""Joins by time: the first row at or after an instant, in blocks of time with a carried row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import attach_carries, block_seconds_for, in_block, time_block


def first_at_or_after(probes: DataFrame, rows: DataFrame, keys: Sequence[str], instant: Column, ts: str, tie: str,
                      take: Sequence[str], name: str = "found", block_seconds: int | None = None) -> DataFrame:
    """The probes with `name`: a struct of `take` of the key's first row at or after `instant`, NULL if there is none.

    Rows of equal time go by `tie`. Probes and rows meet in blocks of time, as wide as the counts allow, in
    one descending pass; a block without a later row of its own takes the first row of the next block that
    has one. Keys are not NULL; probes without an instant find nothing, rows without a time are not found.
    """
    shape = F.struct(*[F.col(c) for c in take])
    probe = F.struct(*[F.col(c) for c in probes.columns])
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    data = rows.where(F.col(ts).isNotNull())
    data = data.select(*named, F.col(ts).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
                       shape.alias("_row"), F.lit(True).alias("_hit"))
    both = data.unionByName(probes.select(*named, instant.cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), probe.alias("_probe")),
                            allowMissingColumns=True)
    seconds = block_seconds or block_seconds_for(both, own, "_at")
    # The first row of each block, carried to the blocks before it.
    later = Window.partitionBy(*own).orderBy(F.desc("_tb")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by(F.struct("_hit", "_row"), F.when(F.col("_hit"), F.struct("_at", "_tie")))
    carried = attach_carries(both, own, time_block("_at", seconds), {"_next": (first, lambda c, w: F.last(c, ignorenulls=True).over(later))})
    descending = in_block(own, [F.desc("_at"), F.desc("_kind"), F.desc("_tie")]).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("_hit"), F.struct("_hit", "_row")), ignorenulls=True).over(descending)
    found = F.when(F.col("_at").isNotNull(), F.coalesce(inside, F.col("_next")))
    return carried.withColumn("_found", found).where(F.col("_kind") == 0).select("_probe.*", F.col("_found._row").alias(name))
