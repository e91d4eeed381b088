"""Keyed permutation of the numbers 0 .. n-1 as a column, and reproducible global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6


def permuted(index: Column, n: int, key: int = 42) -> Column:
    """The place of `index` under a Feistel permutation of 0 .. n-1.

    The network runs over a grid of a rows and b columns with a * b >= n and less than b cells to
    spare; both halves are updated in turn by keyed hashes modulo their radix, so every round is a
    bijection of the grid. A value that leaves 0 .. n-1 is sent through again (cycle walking). The
    walk ends after at most as many steps as there are spare cells; beyond that count, or beyond the
    steps that fail once in 2**128, the column raises an error instead of giving a wrong place.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    b = math.isqrt(n - 1) + 1
    a = -(-n // b)
    spare = a * b - n
    steps = min(spare, math.ceil(128 / math.log2(a * b / spare))) if spare else 0

    def mixed(half: Column, turn: Column, radix: int) -> Column:
        return F.pmod(F.xxhash64(half, turn, F.lit(key).cast("long")), F.lit(radix).cast("long"))

    def turned(state: Column, turn: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.when(turn % 2 == 0, F.struct(((left + mixed(right, turn, a)) % a).alias("left"), right.alias("right"))
                      ).otherwise(F.struct(left.alias("left"), ((right + mixed(left, turn, b)) % b).alias("right")))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turned,
                           lambda s: s["left"] * F.lit(b).cast("long") + s["right"])

    place = once(index.cast("long"))
    if steps:
        place = F.aggregate(F.array_repeat(F.lit(0), steps), place,
                            lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(place < n, place).otherwise(
        F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Add gapless global row numbers that depend on the keys of all rows alone, not on files or tasks.

    Rows fall into about sqrt(n) buckets by a hash of the keys; the prefix sums of the bucket counts
    (one small row per bucket) give each bucket's first number, and rows are ranked inside their
    bucket. Rows equal in all keys get neighbouring numbers in any order. The rows are shuffled once.
    """
    bucket, first = f"{name}_bucket", f"{name}_first"
    placed = df.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(math.isqrt(n) + 1)))
    counts = placed.groupBy(bucket).count()
    before = F.sum("count").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(bucket, F.coalesce(before, F.lit(0)).alias(first))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    return placed.join(starts, bucket).withColumn(name, F.col(first) + rank - 1).drop(bucket, first)
