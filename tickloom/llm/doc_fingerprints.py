"""Operator 9: weighted SimHash of documents and a search by permuted block tables (native)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage, text_or_empty

#: Two votes per number: bits j and j + 32 of a hash, 32 bits apart.
PAIR = 0x0000_0001_0000_0001
LANE = 0xFFFF_FFFF
SPACE = r"[\x20\x09-\x0D]+"
#: Text per block of the order by doc_id, and the most blocks there are.
BLOCK_BYTES, MOST_BLOCKS = 16 << 20, 100_000
ROW_BITS = 38


def votes(term: Column) -> list[Column]:
    """Aggregates of exploded terms: the weight, then 32 sums of two votes each.

    A term weighs its characters less two, one at least, so that short words which every text shares
    say less; an empty term weighs nothing. Sums stay below 2**32 for any text, as weights add up to
    no more than its characters.
    """
    weight = F.when(F.coalesce(F.char_length(term), F.lit(0)) == 0, 0).otherwise(F.greatest(F.char_length(term) - 2, F.lit(1))).cast("long")
    hashed = F.xxhash64(term)
    return [F.sum(weight).alias("weight")] + [
        F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(F.lit(PAIR)) * weight).alias(f"v{j}") for j in range(32)]


def majority() -> Column:
    """The fingerprint from the sums of `votes`: a bit is set if terms of over half the weight set it."""
    bits = []
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        bits += [F.when(side * 2 > F.col("weight"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
                 for side, k in ((low, j), (high, j + 32))]
    return reduce(Column.bitwiseOR, bits)


def terms(text: Column) -> Column:
    return F.split(F.lower(text), SPACE)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `bits` of each row; `keys` must tell rows apart. Terms are summed before the shuffle.

    A NULL text counts as empty; a text without terms has fingerprint zero.
    """
    exploded = rows.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return exploded.groupBy(*keys).agg(*votes(F.col("term"))).select(*keys, majority().alias("bits"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the share of different bits stands for; 0 from a right angle on."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(math.pi / 64)))


def block_tables(bits: Column, radius: int = 3, extra: int = 3) -> list[Column]:
    """(table, key) for each permuted table: the bits of `extra` of radius + extra blocks in front.

    Two fingerprints within the radius leave at least `extra` blocks untouched, so they have the same
    key in the table that puts just these blocks in front.
    """
    n = radius + extra
    bounds = [round(i * 64 / n) for i in range(n + 1)]
    out = []
    for table, chosen in enumerate(combinations(range(n), extra)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(table).alias("table"), bits.bitwiseAND(F.lit(signed)).alias("key")))
    return out


def within_radius(queries: DataFrame, every: DataFrame, radius: int = 3) -> DataFrame:
    """(query, bits, distance): all distinct `bits` of `every` within the radius of those of `queries`.

    Exact: every pair meets in a table, and its distance is measured. Both sides are made distinct
    first, so copies cost nothing and membership is a join on the fingerprint; NULL bits match nothing.
    A fingerprint finds itself at distance 0 if `every` holds it.
    """
    def tables(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("bits").alias(name)).where(F.col(name).isNotNull()).distinct().select(
            name, F.explode(F.array(*block_tables(F.col(name), radius))).alias("t")).select(name, "t.table", "t.key")

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("bits")))
    return (tables(queries, "query").join(tables(every, "bits"), ["table", "key"]).where(distance <= radius)
            .select("query", "bits", distance.alias("distance")).distinct())


def _blocks(documents: DataFrame) -> tuple[Column, int]:
    """The block of a doc_id, in descending order from 0, with about BLOCK_BYTES of text in each."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n_bytes = documents.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    n = min(MOST_BLOCKS, max(1, -(-n_bytes // BLOCK_BYTES)))
    if n == 1:
        return F.lit(0), 1
    shares = [i / n for i in range(1, n)]
    bounds = documents.agg(F.percentile_approx(order, shares, max(10_000, 20 * n))).first()[0]
    if not bounds:
        return F.lit(0), 1
    bounds = sorted(set(bounds))
    limits = F.array(*map(F.lit, bounds)) if len(bounds) < 200 else F.from_json(F.lit(str(bounds)), "array<long>")
    state = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))  # number of bounds below doc_id

    def halved(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(
            F.element_at(limits, middle + 1) < order, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), middle.alias("high")))

    below = F.aggregate(F.array_repeat(F.lit(0), len(bounds).bit_length() + 1), state, halved, lambda s: s["low"])
    return F.lit(len(bounds)) - below, len(bounds) + 1


def with_next(documents: DataFrame) -> DataFrame:
    """row, doc_id, text, next_row, next_text in descending order of doc_id; after the last comes the first.

    The order is cut into blocks at quantiles of doc_id. Every block is sorted in a task of its own and
    gets a copy of the first row of the block that follows, so texts are shuffled once. NULL doc_ids
    come last; rows of one doc_id are ordered by their text's hash. `row` numbers rows uniquely.
    """
    place, _ = _blocks(documents)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    placed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                              order.alias("k"), place.cast("int").alias("block"))
    # One row per block: bounded by the number of blocks.
    firsts = placed.groupBy("block").agg(F.max("k").alias("k")).orderBy("block").collect()
    spark = documents.sparkSession
    heads = spark.createDataFrame(
        [(firsts[(i + 1) % len(firsts)]["k"], r["block"]) for i, r in enumerate(firsts)], "k long, goes_to int")
    only = Window.partitionBy("goes_to").orderBy(F.xxhash64("text"))
    halo = (placed.join(F.broadcast(heads), "k").withColumn("i", F.row_number().over(only)).where("i = 1")
            .select("doc_id", "text", "k", F.col("goes_to").alias("block"), F.col("block").alias("from_block"), F.lit(1).alias("halo")))
    rows = placed.select("*", F.col("block").alias("from_block"), F.lit(0).alias("halo")).unionByName(halo)
    window = Window.partitionBy("block").orderBy("halo", F.col("k").desc(), F.xxhash64("text"))
    base = F.lit(1 << ROW_BITS)
    row = F.col("block") * base + F.row_number().over(window)
    after = F.lead(F.struct("halo", "from_block", "text")).over(window)
    return (rows.withColumn("row", row).withColumn("after", after).where("halo = 0")
            .withColumn("next_row", F.when(F.col("after.halo") == 1, F.col("after.from_block") * base + 1).otherwise(F.col("row") + 1))
            .select("row", "doc_id", "text", "next_row", F.col("after.text").alias("next_text")))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as
    many (or all there are) of the next document in descending order of doc_id; after the last comes
    the first, and a lone document is its own next. Fingerprints are 16 hex digits; equal texts have
    equal ones. NULL texts count as empty and have fingerprint zero. Repeated rows stay apart. An
    empty table gives no rows.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    keys = ["row", "next_row", "doc_id", "n_chars", "edited_sha", "part"]
    two = with_next(documents).select("row", "next_row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text",
                                      edited.alias("edited"))
    parts = two.select("row", "next_row", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha"),
                       F.posexplode(F.array("text", "edited")).alias("part", "text"))
    prints = fingerprints(parts, keys)
    joined = prints.groupBy("row", "next_row", "doc_id", "n_chars", "edited_sha").agg(
        F.max(F.when(F.col("part") == 0, F.col("bits"))).alias("own"), F.max(F.when(F.col("part") == 1, F.col("bits"))).alias("edit"))
    joined = stage(joined, "prints")
    follows = joined.select(F.col("row").alias("next_row"), F.col("own").alias("following"))

    def shown(bits: str) -> Column:
        return F.lpad(F.lower(F.hex(bits)), 16, "0")

    return joined.join(follows, "next_row").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), shown("own").alias("fingerprint"),
        shown("edit").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
