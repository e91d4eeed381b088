"""Operator 1: reproducible shards from a Feistel permutation of global row numbers (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_or_empty
from tickloom.llm.permute import numbered, permuted


def shard_rows(rows: DataFrame, keys: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """Add `shard` (0 .. n_shards-1) and `slot` (gapless from 0 in each shard) to every row.

    The law is `rows`: counts of two shards differ by one at most. Row numbers come from the keys
    alone, the permutation from (number of rows, seed), so a rerun on any layout of files gives the
    same places, and place p is in shard p mod n_shards at slot p div n_shards without a lookup.
    Rows that are equal in all keys get different places in any order among them. NULL keys are
    ordinary values and come first. An empty table gives no rows. A column `shard` or `slot` of the
    input is replaced.
    """
    n = rows.count()
    rows = rows.drop("shard", "slot")
    place = "shard_place"
    return (numbered(rows, keys, n, place)
            .withColumn(place, permuted(F.col(place), n, seed))
            .withColumn("shard", F.pmod(F.col(place), F.lit(n_shards)).cast("int"))
            .withColumn("slot", F.floor(F.col(place) / n_shards).cast("long"))
            .drop(place))


def shard_documents(documents: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; `documents` needs doc_id and text.

    `size` is the bytes of the text plus 8; a NULL text has none and the check sum of an empty one.
    Texts are read once, to 20 bytes a row, before anything is shuffled. `grown_shard` is NULL: under
    the law `rows` one more shard deals all rows anew.
    """
    text = text_or_empty()
    slim = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(slim, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
