"""Operator 2: token ids in training order, written as fixed-stride binary shards.

A record is a header (doc_id as signed 64 bit, 1 in the flag if it is NULL, piece, number of ids) and
`length` ids of 16 bits (32 where the vocabulary needs them), padded with zeros, all little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.byte_tokens import FILE, byte_tokens
from tickloom.llm.common import ArrivingFile, batched, filesystem, make_folder, new_folder, rows_of, stage, text_or_empty
from tickloom.llm.permute import permuted

HEADER = "<qIII"
HEADER_SIZE = struct.calcsize(HEADER)
SEQUENCES = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
                       ("length", pa.int32()), ("ids", pa.binary())])
RECORDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                     ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64()), ("byte_offset", pa.int64())])
RECORD_COLUMNS = ("doc_id long, piece int, start long, length int, ids_crc32 long, shard int, slot long, "
                  "byte_offset long")
INDEX = pa.schema([("shard", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64())])
BATCH_BYTES = 8 << 20


def _upper(length: int):
    """Most pieces a text can have: an id takes a byte at least, and the end id follows."""
    return F.floor((F.octet_length(text_or_empty()) + length) / length).cast("long")


def write_training_order(documents: DataFrame, folder: str, length: int = 512, key: int = 42, end_id: int = 50256,
                         tokenizer: str | None = None, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write shards under `folder`; returns the index: shard, rows, bytes, first_slot (staged).

    Every document is its ids and `end_id`, cut into sequences of at most `length` ids. The bytes of
    a text bound its sequences, so a scan of sizes numbers all possible sequences before anything is
    encoded: number = those of earlier input partitions + those earlier in this one. The keyed
    Feistel permutation of these numbers is the training order. Sequences go once through a shuffle,
    straight to the range of the order they belong to, are sorted there and appended to the range's
    shard at a fixed stride. Numbers that turned out not to be needed leave no gap: a sequence's slot
    is its shard's first slot (prefix sums over the index, one row per shard) plus its row there.

    The order depends on the rows, their layout in the input and the key. `documents` must be a scan
    of stored files, which Spark splits alike for both passes; a task that finds other rows than the
    first pass counted stops with an error. NULL and empty texts are one sequence of `end_id`; NULL
    doc_ids are kept; repeated rows are written one by one; an empty table gives an empty index.
    """
    tokenizer = tokenizer or public_tokenizers.path(FILE)
    # Ids of the whole vocabulary decide the width, not those that occur.
    kind = "<u2" if byte_tokens(tokenizer).n_ids <= 1 << 16 and end_id < 1 << 16 else "<u4"
    stride = HEADER_SIZE + length * np.dtype(kind).itemsize
    # One number per input partition: bounded by the tasks of a scan.
    sizes = {r[0]: r[1] for r in documents.select(F.spark_partition_id().alias("p"), _upper(length).alias("n"))
             .groupBy("p").agg(F.sum("n")).collect()}
    firsts, n = {}, 0
    for p in sorted(sizes):
        firsts[p] = n
        n += sizes[p]
    n_shards = max(1, -(-n * stride // shard_bytes))

    def encoded(batches):
        coder, part = byte_tokens(tokenizer), TaskContext.get().partitionId()

        def made():
            number = firsts.get(part, 0)
            for doc_id, text in rows_of(batches):
                ids = np.append(coder.encode(text), end_id).astype(kind)
                for piece, start in enumerate(range(0, len(ids), length)):
                    cut = ids[start:start + length]
                    yield number + piece, doc_id, piece, len(cut), cut.tobytes()
                number += (len(text.encode()) + length) // length
            if number != firsts.get(part, 0) + sizes.get(part, 0):
                raise RuntimeError("the input was split differently on the second pass; stage it first")

        yield from batched(made(), SEQUENCES, 2048)

    sequences = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        encoded, "place long, doc_id long, piece int, length int, ids binary")
    ordered = (sequences.withColumn("place", permuted(F.col("place"), n, key))
               .withColumn("shard", F.floor(F.col("place") * n_shards / max(n, 1)).cast("int"))
               .repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "place"))
    make_folder(folder)

    def written(batches):
        shard, rows = None, 0
        arriving = sink = None
        try:
            for batch in batches:
                for to, doc_id, piece, size, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        shard, arriving = to, ArrivingFile(shard_file(folder, to))
                        sink = arriving.__enter__()
                    elif to != shard:
                        raise RuntimeError("a task got two ranges")
                    sink.write(struct.pack(HEADER, doc_id or 0, int(doc_id is None), piece, size) + ids.ljust(stride - HEADER_SIZE, b"\0"))
                    rows += 1
        except BaseException as error:
            if sink is not None:
                arriving.__exit__(type(error), error, None)
            raise
        if sink is not None:
            arriving.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "rows": rows, "bytes": rows * stride}], INDEX)

    index = stage(ordered.select("shard", "doc_id", "piece", "length", "ids").mapInArrow(
        written, "shard int, rows long, bytes long"), "token-index")
    before = F.sum("rows").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return index.withColumn("first_slot", F.coalesce(before, F.lit(0)))


def shard_file(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/tokens-{shard:06d}.bin"


def read_training_order(index: DataFrame, folder: str, length: int = 512, from_slot: int = 0, wide: bool = False) -> DataFrame:
    """Records from `from_slot` on, as written: every task reads one shard forwards from a computed byte.

    Returns doc_id, piece, start, length, ids_crc32 (of the ids as unsigned 32 bit), shard, slot and
    byte_offset (of the record in its shard).
    """
    kind = "<u4" if wide else "<u2"
    stride = HEADER_SIZE + length * np.dtype(kind).itemsize

    def read(batches):
        def made():
            for shard, rows, first in rows_of(batches):
                row = max(0, from_slot - first)
                store, path = filesystem(shard_file(folder, shard))
                with store.open_input_file(path) as source:
                    source.seek(row * stride)
                    while row < rows:
                        block = source.read(min(rows - row, max(1, BATCH_BYTES // stride)) * stride)
                        for at in range(0, len(block), stride):
                            doc_id, null, piece, size = struct.unpack_from(HEADER, block, at)
                            ids = np.frombuffer(block, kind, size, at + HEADER_SIZE).astype("<u4")
                            yield (None if null else doc_id, piece, piece * length, size, zlib.crc32(ids.data), shard,
                                   first + row, row * stride)
                            row += 1

        yield from batched(made(), RECORDS)

    wanted = index.where(F.col("first_slot") + F.col("rows") > from_slot).select("shard", "rows", "first_slot")
    # One row per shard and task: reading is spread over the cluster.
    last = index.agg(F.max("shard")).first()[0]
    return wanted.repartitionById((last or 0) + 1, F.col("shard")).mapInArrow(read, RECORD_COLUMNS)


def training_order(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Write all documents in training order, then read every shard back."""
    folder = new_folder(spark, "token-shards")
    return read_training_order(write_training_order(documents, folder), folder)
