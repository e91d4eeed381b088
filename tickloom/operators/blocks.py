"""Row-ordered windows over series of any length.

`Window.partitionBy(series).orderBy(ts)` puts a whole series into one task, so
one series with a third of all rows would stop the job. The operators here cut
every series into bounded blocks and stay exact:

* a *coarse block* is an order-preserving bucket of the order column (a time
  bucket, say). Per-block aggregates are tiny, their prefix over a series gives
  every block what lies before it (row counts, last value, running maximum) and
  joins back on (series, block), which no hot series can skew;
* a *row block* holds `block_rows` consecutive rows plus a halo of the rows just
  before and after it. Frames up to the halo size are computed per row block.

Series keys are NOT NULL columns of the tables. The coarse block should be small enough that the densest series has at most some ten
million rows in one, and wide enough that most blocks hold many rows; the block
table is then a tiny fraction of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Carry = tuple[Column, Callable[[Column, WindowSpec], Column]]

SUB_ROWS = 256  # rows per sub-block; prefix weights q^-k stay small inside one


def time_block(ts: Column | str, seconds: int) -> Column:
    """Coarse block: time bucket of the given width; rows without a time come first."""
    col = F.col(ts) if isinstance(ts, str) else ts
    bucket = F.floor(F.unix_seconds(col.cast("timestamp")) / F.lit(seconds)).cast("long")
    return F.coalesce(bucket, F.lit(-(2**62)))


def block_seconds_for(df: DataFrame, keys: Sequence[str], ts: str, target_rows: int = 5_000_000,
                      narrowest: int = 60, widest: int = 28 * 86400) -> int:
    """Coarse block width at which the densest hour of any series gives `target_rows` per block.

    One aggregation over (keys, ts); only the resulting number comes back.
    """
    hourly = df.groupBy(*keys, time_block(ts, 3600).alias("_h")).count()
    densest = hourly.agg(F.max("count")).first()[0] or 1
    return int(min(widest, max(narrowest, target_rows * 3600 // densest)))


def prefix_for(df: DataFrame, keys: Sequence[str], name: str, target_rows: int = 1_000_000,
               lengths: Sequence[int] = (0, 1, 2, 3, 4, 6, 8, 12, 16, 32)) -> int:
    """The fewest leading characters of `name` at which no series has more than `target_rows` rows of one prefix.

    One aggregation, of which a row per length comes back; the longest length where none is enough.
    """
    each = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(name, 1, n).alias("p")) for n in lengths])).alias("c"))
    most = each.groupBy(*keys, "c").count().groupBy("c.n").agg(F.max("count").alias("most")).where(F.col("most") <= target_rows)
    found = most.agg(F.min("n")).first()[0]
    return max(lengths) if found is None else found


def before(agg: Callable[[Column], Column]) -> Callable[[Column, WindowSpec], Column]:
    """Carry: `agg` over all earlier blocks of the series."""
    return lambda c, w: agg(c).over(w.rowsBetween(Window.unboundedPreceding, -1))


def previous(c: Column, w: WindowSpec) -> Column:
    """Carry: the value of the nearest earlier block that has rows."""
    return F.lag(c).over(w)


def whole(agg: Callable[[Column], Column]) -> Callable[[Column, WindowSpec], Column]:
    """Carry: `agg` over all blocks of the series."""
    return lambda c, w: agg(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def attach_carries(df: DataFrame, keys: Sequence[str], block: Column, carries: Mapping[str, Carry]) -> DataFrame:
    """Add `_tb` (coarse block) and one column per carry.

    A carry is (aggregate of one block, function of its prefix window). The
    block table has one row per non-empty block; the join key holds the block,
    so rows of a hot series spread over as many tasks as it has blocks.
    """
    tagged = df.withColumn("_tb", block)
    per_block = tagged.groupBy(*keys, "_tb").agg(*[agg.alias(f"_a_{n}") for n, (agg, _) in carries.items()])
    w = Window.partitionBy(*keys).orderBy("_tb")
    table = per_block.select(*keys, "_tb", *[over(F.col(f"_a_{n}"), w).alias(n) for n, (_, over) in carries.items()])
    return tagged.join(table, [*keys, "_tb"])


def in_block(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys, "_tb").orderBy(*order)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                  means: Sequence[str] = (), rows_of: DataFrame | None = None) -> DataFrame:
    """Add `pos` (0-based row number in the series) and `n_rows`.

    `order` must be unique inside a series and `block` must not decrease along
    it. `means` adds `<c>_mean` and `<c>_std` (population) of the whole series,
    merged from block moments, without a join on the series key alone.
    `rows_of` may name a narrower frame with the same rows to count from, so
    that joins which only add columns to `df` are not run for counting.
    """
    tagged = df.withColumn("_tb", block)
    counted = tagged if rows_of is None else rows_of.withColumn("_tb", block)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for c in means:
        aggs += [F.count(c).alias(f"_c_{c}"), F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}")]
    w = Window.partitionBy(*keys).orderBy("_tb")
    table = counted.groupBy(*keys, "_tb").agg(*aggs).withColumns({
        "_start": F.coalesce(before(F.sum)(F.col("_cnt"), w), F.lit(0)),
        "n_rows": whole(F.sum)(F.col("_cnt"), w),
    })
    every = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if means:
        rows = {c: F.col(f"_c_{c}") for c in means}
        table = table.withColumns({
            f"{c}_mean": F.sum(F.col(f"_m_{c}") * n).over(every) / F.sum(n).over(every) for c, n in rows.items()})
        table = table.withColumns({
            f"{c}_std": F.sqrt(F.sum((F.col(f"_v_{c}") + F.pow(F.col(f"_m_{c}") - F.col(f"{c}_mean"), 2)) * n).over(every)
                               / F.sum(n).over(every)) for c, n in rows.items()})
    table = table.select(*keys, "_tb", "_start", "n_rows", *[f"{c}_{s}" for c in means for s in ("mean", "std")])
    joined = tagged.join(table, [*keys, "_tb"])
    pos = F.col("_start") + F.row_number().over(in_block(keys, order)) - 1
    return joined.withColumn("pos", pos).drop("_tb", "_start")


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows of every series with their `age`, 0 for the last.

    Spark's group limit leaves at most `n` rows per series and task before the only shuffle, so the
    input is read once and a hot series is cut down where it is read.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).withColumn("age", F.col("_rank") - 1).drop("_rank")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, n: int) -> DataFrame:
    """The newest `n` rows of every series, with `pos` and `n_rows`.

    Blocks that end before the wanted rows are dropped before anything is
    sorted, so only the tail of a long series is touched.
    """
    return _kept_blocks(df, keys, order, block, lambda start, count, rows: start + count > rows - n) \
        .where(F.col("pos") >= F.col("n_rows") - n)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, n: int) -> DataFrame:
    """The oldest `n` rows of every series, with `pos` and `n_rows`."""
    return _kept_blocks(df, keys, order, block, lambda start, count, rows: start < n).where(F.col("pos") < n)


def _kept_blocks(df, keys, order, block, keep) -> DataFrame:
    count = F.count(F.lit(1))
    tagged = attach_carries(df, keys, block, {
        "_start": (count, lambda c, w: F.coalesce(before(F.sum)(c, w), F.lit(0))),
        "_count": (count, lambda c, w: c),
        "n_rows": (count, whole(F.sum)),
    })
    kept = tagged.where(keep(F.col("_start"), F.col("_count"), F.col("n_rows")))
    pos = F.col("_start") + F.row_number().over(in_block(keys, order)) - 1
    return kept.withColumn("pos", pos).drop("_tb", "_start", "_count")


@dataclass(frozen=True)
class SeriesBlocks:
    """Row blocks with halo for frames of bounded size.

    `back` / `ahead` are the numbers of earlier / later rows any home row may
    need, counting chained steps (a 20-row frame over a first difference needs
    20). `open` adds `pos`, `n_rows`, `_blk`, `_home`, `_sub`; `close` drops the
    halo copies. All window specs below share the clustering (series, row
    block) and one sort order, so they add a single shuffle and a single sort.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: Column
    back: int = 0
    ahead: int = 0
    block_rows: int = 65536

    def __post_init__(self):
        if self.block_rows % SUB_ROWS or self.block_rows < max(self.back, self.ahead):
            raise ValueError("block_rows must be a multiple of 256 and at least the halo")

    def open(self, df: DataFrame, means: Sequence[str] = (), rows_of: DataFrame | None = None,
             placed: bool = False) -> DataFrame:
        """`placed` takes `pos` and `n_rows` from the frame instead of computing them."""
        if not placed:
            df = with_position(df, self.keys, self.order, self.block, means, rows_of)
        size = F.lit(self.block_rows)
        home = F.floor(F.col("pos") / size).cast("long")
        offset = F.col("pos") % size
        targets = [home]
        if self.back:
            more = (home + 1) * size < F.col("n_rows")
            targets.append(F.when((offset >= self.block_rows - self.back) & more, home + 1))
        if self.ahead:
            targets.append(F.when((offset < self.ahead) & (home > 0), home - 1))
        return df.withColumns({
            "_home": home,
            "_blk": F.explode(F.array_compact(F.array(*targets))),
            "_sub": F.floor(F.col("pos") / SUB_ROWS).cast("long"),
        })

    @staticmethod
    def close(df: DataFrame) -> DataFrame:
        return df.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home", "_sub")

    def row_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk").orderBy("_sub", "pos")

    def rows(self, low: int, high: int) -> WindowSpec:
        return self.row_window().rowsBetween(low, high)

    def sub_running(self) -> WindowSpec:
        """Running frame inside one sub-block."""
        return Window.partitionBy(*self.keys, "_blk", "_sub").orderBy("pos") \
            .rowsBetween(Window.unboundedPreceding, 0)

    def sub_before(self, distance: int) -> WindowSpec:
        """All rows of the sub-block `distance` places earlier."""
        return Window.partitionBy(*self.keys, "_blk").orderBy("_sub").rangeBetween(-distance, -distance)

    def block_all(self) -> WindowSpec:
        return self.row_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
