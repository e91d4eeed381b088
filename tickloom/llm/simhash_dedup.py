"""Operator 6: SimHash near-duplicates by vantage-point trees over fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batched, rows_of, stage, text_or_empty
from tickloom.llm.components import components

SEED = 42
#: A shard of the tree holds about sqrt(n) * SHARD_ROOT fingerprints, SHARD_ROWS at least; inside, the
#: tree goes on to groups of SMALL. With sqrt(n) shards the boundary copies grow as n ** 0.28 per row.
SHARD_ROWS, SHARD_ROOT, SMALL = 4096, 16, 256
#: Fingerprints drawn on average to place the vantage points of the shards (a documented bound).
SAMPLE_ROWS = 65_536
BLOCK = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """Majority vote of the bits of the hashes of all word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - width + 1)
    low, high = starts[:n].tolist(), (ends[width - 1:] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(low[at:at + BLOCK], high[at:at + BLOCK], strict=True)),
                             np.uint64, min(BLOCK, n - at))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, bits (the fingerprint as a signed 64-bit number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("bits", pa.int64())])

    def made(batches):
        yield from batched(((doc_id, known, int(np.uint64(fingerprint(text)).astype(np.int64)))
                            for doc_id, known, text in rows_of(batches)), schema)

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")).mapInArrow(
        made, "doc_id long, text_hash long, bits long")


def split_radius(distances: np.ndarray, radius: int) -> int | None:
    """The distance m at which {d <= m + radius} and {d > m} are nearest in size; None if neither shrinks enough."""
    counts = np.bincount(distances, minlength=65 + radius)
    upto = np.cumsum(counts)
    n = upto[-1]
    inner = upto[np.minimum(np.arange(64) + radius, len(upto) - 1)]
    worst = np.maximum(inner, n - upto[:64])
    m = int(worst.argmin())
    return m if worst[m] <= 0.9 * n else None


def vantage(bits: np.ndarray, radius: int) -> tuple[np.uint64, np.ndarray, int] | None:
    """The best of a few vantage points among the fingerprints themselves."""
    best = None
    for i in {0, len(bits) // 3, len(bits) // 2, len(bits) - 1}:
        distances = np.bitwise_count(bits ^ bits[i]).astype(np.int64)
        m = split_radius(distances, radius)
        if m is not None:
            worst = max((distances <= m + radius).sum(), (distances > m).sum())
            if best is None or worst < best[0]:
                best = worst, bits[i], distances, m
    return best and best[1:]


def tree(bits: np.ndarray, radius: int, small: float) -> tuple | None:
    """(vantage point, m, inner, outer) or None for a shard.

    Two fingerprints within `radius` of each other differ by no more in their distance to the vantage
    point. So with inner = {d <= m + radius} and outer = {d > m}, which overlap at the boundary, at
    least one side holds both.
    """
    found = vantage(bits, radius) if len(bits) > small else None
    if found is None:
        return None
    point, distances, m = found
    return point, m, tree(bits[distances <= m + radius], radius, small), tree(bits[distances > m], radius, small)


def shards_of(bits: np.ndarray, node: tuple | None, radius: int) -> list[tuple[int, np.ndarray]]:
    """(shard, rows in it): rows near a boundary are in several shards."""
    out, stack, number = [], [(node, np.arange(len(bits)))], 0
    while stack:
        at, rows = stack.pop()
        if at is None:
            out.append((number, rows))
            number += 1
            continue
        point, m, inner, outer = at
        distances = np.bitwise_count(bits[rows] ^ point).astype(np.int64)
        stack += [(outer, rows[distances > m]), (inner, rows[distances <= m + radius])]
    return out


def linked(bits: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints of one shard the index of the smallest linked to each, through any chain.

    The tree goes on until groups are small or cannot be split; pairs of a group are compared in
    blocks. Links go into a union-find, so a dense group costs no list of its pairs.
    """
    parent = np.arange(len(bits))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def tie(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    stack = [np.arange(len(bits))]
    while stack:
        rows = stack.pop()
        own = bits[rows]
        found = vantage(own, radius) if len(rows) > SMALL else None
        if found:
            _, distances, m = found
            stack += [rows[distances <= m + radius], rows[distances > m]]
            continue
        step = max(1, (1 << 20) // max(1, len(rows)))
        for at in range(0, len(rows), step):
            i, j = np.nonzero(np.bitwise_count(own[at:at + step, None] ^ own[None, at:]) <= radius)
            ahead = j > i
            i, j = i[ahead], j[ahead]
            if len(i) > 4 * len(rows):  # a dense block: ties already made need no second look
                for k in np.unique(i).tolist():
                    others = rows[at + j[i == k]]
                    parent_of = parent[others]
                    me = root(int(rows[at + k]))
                    tie(np.full(int((parent_of != me).sum()), me), others[parent_of != me])
            else:
                tie(rows[at + i], rows[at + j])
    return np.array([root(i) for i in range(len(bits))], np.int64)


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links of distinct `bits`, enough to connect all that are within `radius` by any chain.

    A bounded sample places the vantage points; every fingerprint goes to all shards of the tree that
    its boundary distances allow (1.3 times as many rows per level), each shard is searched exactly in
    a task of its own and reports at most one link per fingerprint.
    """
    n = distinct.count()
    size = max(SHARD_ROWS, SHARD_ROOT * math.isqrt(n))
    below = int(min(1.0, SAMPLE_ROWS / max(1, n)) * 2**53)
    drawn = distinct.where(F.shiftrightunsigned(F.xxhash64("bits"), 11) < below).collect() if n > size else []
    sample = np.sort(np.array([r["bits"] for r in drawn], np.int64).astype(np.uint64))
    # Shards of the sample shrink in proportion; below 64 rows its medians say little.
    plan = tree(sample, radius, max(64, size * len(sample) / max(n, 1))) if len(sample) else None

    def dealt(batches):
        for batch in batches:
            bits = batch.column(0).to_numpy().astype(np.uint64)
            for shard, rows in shards_of(bits, plan, radius):
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), shard, np.int64)), pa.array(bits[rows].astype(np.int64))],
                        names=["shard", "bits"])

    def searched(batches):
        def found(parts: list[np.ndarray]):
            bits = np.unique(np.concatenate(parts).astype(np.uint64))
            least = linked(bits, radius)
            ends = np.flatnonzero(least != np.arange(len(bits)))
            if len(ends):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bits[ends].astype(np.int64)), pa.array(bits[least[ends]].astype(np.int64))], names=["a", "b"])

        shard, held = None, []
        for batch in batches:
            shards, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.append(0, np.flatnonzero(np.diff(shards)) + 1) if len(shards) else np.zeros(0, int)
            for low, high in zip(cuts, np.append(cuts[1:], len(shards)), strict=True):
                if held and shards[low] != shard:
                    yield from found(held)
                    held = []
                shard = shards[low]
                held.append(bits[low:high])
        if held:
            yield from found(held)

    dealt_out = distinct.select("bits").mapInArrow(dealt, "shard long, bits long")
    # Comparing is work that the size of the rows does not show, so tasks are not merged by size.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_out.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(searched, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    Texts are lower-cased in A-Z, cut into words at white space and into shingles of three words
    (fewer words: one shingle of all; none: fingerprint zero, linked like any other). A bit is set if
    it is set in more than half of the shingles' XXH64. Fingerprints link at `radius` or fewer
    different bits; component_id is the smallest doc_id that can be reached. NULL texts count as
    empty. A NULL doc_id takes part but is never a component_id unless there is no other. Copies
    collapse to one fingerprint before any search. An empty table gives no rows.
    """
    prints = stage(fingerprints(documents), "fingerprints")
    return prints.join(named_groups(prints, radius), "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def named_groups(prints: DataFrame, radius: int) -> DataFrame:
    """bits, root (smallest fingerprint of the group), component_id (its smallest doc_id) for every distinct fingerprint."""
    distinct = stage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(distinct, radius))
    rooted = distinct.join(groups.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    rooted = stage(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("bits", "root", "component_id")


#: What tells rows with a doc_id apart.
ROW_KEY = ("doc_id", "_text")


def one_of_each(documents: DataFrame, radius: int = 3) -> DataFrame:
    """One row of every group of near copies, all columns as they are.

    Groups are those of `near_duplicates`, and a row belongs to the group of its own text: it is told
    apart by doc_id and text, so one doc_id on texts of two groups stands for each of them on its own.
    Of a group the row with the smallest doc_id stays, one of its texts and one of equal rows. Rows with a
    NULL doc_id cannot be named and stay. A NULL text counts as empty. An empty table gives no rows.
    """
    prints = stage(fingerprints(documents), "fingerprints")
    rows = prints.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash", "bits").agg(F.count(F.lit(1)).alias("_rows"))
    keyed = stage(rows.join(named_groups(prints, radius), "bits").select(
        "root", "doc_id", F.col("text_hash").alias("_text"), "_rows"), "groups")
    first = keyed.groupBy("root").agg(F.min(F.struct(*ROW_KEY)).alias("_first"))
    marked = stage(keyed.join(first, "root").select(*ROW_KEY, "_rows", (F.col("_first") == F.struct(*ROW_KEY)).alias("_stays")), "marked")
    gone = marked.where(~F.col("_stays")).select(*ROW_KEY)
    repeated = marked.where("_stays AND _rows > 1").select(*ROW_KEY)
    told = documents.withColumn("_text", F.xxhash64(text_or_empty()))
    # The rows that go grow with the corpus, so they are merged in a shuffle at every size, never broadcast.
    single = told.join(gone.unionByName(repeated).hint("merge"), list(ROW_KEY), "left_anti")
    return single.unionByName(told.join(repeated, list(ROW_KEY), "left_semi").dropDuplicates(list(ROW_KEY))).select(
        *documents.columns)
