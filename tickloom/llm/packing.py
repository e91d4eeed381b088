"""Operator 7: best-fit packing by exact complements."""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.byte_tokens import FILE, byte_tokens
from tickloom.llm.common import batched, rows_of, stage, text_or_empty

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: only the first may be short of the capacity."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def pieces_of(documents: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Whole texts, no shuffle."""

    def encoded(batches):
        coder = byte_tokens(tokenizer)

        def made():
            for doc_id, text in rows_of(batches):
                ids = np.append(coder.encode(text), end_id).astype("<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    yield doc_id, piece, start, length, zlib.crc32(ids[start:start + length].data)
                    start += length

        yield from batched(made(), PIECES)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(encoded, PIECE_COLUMNS)


class Complements:
    """Which one, two or three of the lengths at hand sum up to a gap exactly."""

    def __init__(self, counts: Counter, capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths = sorted(x for x in counts if counts[x])
        self.two = np.zeros(capacity + 1, bool)
        self.index()

    def index(self) -> None:
        """Sums of two lengths at hand."""
        at_hand = np.array(self.lengths, np.int64)
        self.two[:] = False
        if len(at_hand):
            sums = (at_hand[:, None] + at_hand[None, :]).ravel()
            self.two[sums[sums < len(self.two)]] = True

    def exact(self, gap: int, held: Counter) -> tuple[int, ...] | None:
        """Lengths that fill the gap, over those already `held` in the sequence; large ones first."""
        def free(*lengths: int) -> bool:
            need = Counter(lengths) + held
            return all(self.left[x] >= need[x] for x in set(lengths))

        if self.left[gap] and free(gap):
            return (gap,)
        upto = self.lengths[:bisect.bisect_right(self.lengths, gap)]
        if self.two[gap]:
            for x in reversed(upto):
                if 2 * x < gap:
                    break
                if gap - x and self.left[gap - x] and free(x, gap - x):
                    return x, gap - x
        for x in reversed(upto):
            if 3 * x < gap:
                break
            rest = gap - x
            if rest and self.two[rest]:
                for y in reversed(upto):
                    if y > x or y >= rest:
                        continue
                    if 2 * y < rest:
                        break
                    if self.left[rest - y] and free(x, y, rest - y):
                        return x, y, rest - y
        return None

    def take(self, lengths: Counter) -> int:
        """Use the combination as often as the counts allow."""
        times = min(int(self.left[x]) // n for x, n in lengths.items())
        for x, n in lengths.items():
            self.left[x] -= n * times
        gone = [x for x in lengths if not self.left[x]]
        if gone:
            self.lengths = [x for x in self.lengths if self.left[x]]
            self.index()
        return times


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) for all pieces; depends on the counts by length alone.

    The largest length at hand opens a sequence. A combination of one, two or three lengths that
    fills the gap exactly closes it; if there is none, the largest length that fits is added (best
    fit) and the smaller gap is tried again. Each combination is used as often as the counts allow,
    which uses up a length, so there are at most `capacity` combinations whatever the corpus.
    """
    index = Complements(Counter({k: v for k, v in counts.items() if v > 0}), capacity)
    plan = []
    while index.lengths:
        held = Counter([index.lengths[-1]])
        gap = capacity - index.lengths[-1]
        while gap:
            fill = index.exact(gap, held)
            if fill is None:
                fits = [x for x in index.lengths[:bisect.bisect_right(index.lengths, gap)] if index.left[x] > held[x]]
                fill = tuple(fits[-1:])
            if not fill:
                break
            held.update(fill)
            gap -= sum(fill)
        plan.append((index.take(held), tuple(sorted(held.elements(), reverse=True))))
    return plan


def _ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Gapless rank of each piece among those of its length; hot lengths are split over hash buckets."""
    buckets = math.isqrt(n) + 1
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = placed.groupBy("length", "bucket").count()
    before = F.sum("count").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return (placed.join(starts, ["length", "bucket"])
            .withColumn("rank", F.col("first") + inside - 1).drop("bucket", "first"))


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and any others).

    The counts by length (at most `capacity` rows) go to the driver; the plan that comes back is a
    table of at most capacity squared rows, whose ranges of ranks are expanded to at most
    `capacity` places a length. Pieces meet it by length and rank.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(counts, capacity)
    used: Counter = Counter()
    ranges, first_sequence = [], 0
    for times, lengths in plan:
        offset = 0
        slots: Counter = Counter()
        for x in lengths:
            # Ranks used[x] + k * times .. + times - 1 take the k-th place of this length.
            ranges.append((x, used[x] + slots[x] * times, times, first_sequence, offset))
            slots[x] += 1
            offset += x
        for x, n in slots.items():
            used[x] += n * times
        first_sequence += times
    by_length: dict[int, list] = {}
    for x, low, times, sequence, offset in ranges:
        by_length.setdefault(x, []).append((low, sequence, offset))
    schema = "length long, lows array<long>, sequences array<long>, offsets array<long>"
    table = spark.createDataFrame(
        [(x, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) for x, rows in
         ((x, sorted(rows)) for x, rows in by_length.items())], schema)
    ranked = _ranked(pieces, sum(counts.values()))
    # One row of the plan per length, at most `capacity` rows: a size bound for the broadcast.
    joined = ranked.join(F.broadcast(table), "length")
    at = _last_at_most("lows", "rank")
    return (joined.withColumn("at", at)
            .withColumn("sequence_id", F.element_at("sequences", F.col("at")) + F.col("rank") - F.element_at("lows", F.col("at")))
            .withColumn("offset", F.element_at("offsets", F.col("at")))
            .drop("rank", "lows", "sequences", "offsets", "at"))


def _last_at_most(lows: str, rank: str):
    """1-based position of the last of the sorted `lows` that is at most `rank`, by halving."""
    state = F.struct(F.lit(1).alias("low"), F.size(lows).alias("high"))

    def halved(s, _):
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(
            F.element_at(F.col(lows), middle) <= F.col(rank),
            F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    return F.aggregate(F.array_repeat(F.lit(0), 24), state, halved, lambda s: s["low"])


def pack_documents(documents: DataFrame, capacity: int = 1024, end_id: int = 2,
                   tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A document is its ids and `end_id`; NULL and empty texts are one piece of length 1. Documents
    longer than the capacity are cut; piece 0 holds what is left over, the others are full. The ids
    are made once and staged as lengths and check sums; nothing else is shuffled. Repeated rows are
    packed one by one, NULL doc_ids too. An empty table gives no rows.
    """
    tokenizer = tokenizer or public_tokenizers.path(FILE)
    return pack_pieces(stage(pieces_of(documents, capacity, end_id, tokenizer), "pieces"), capacity)
