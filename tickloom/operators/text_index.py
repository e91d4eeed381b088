"""Search for a part of a token's names by a stored inverted index of character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.tables import touched_rows, write_partitions
from tickloom.session import cut_lineage

#: Longest n-gram; shorter questions use their own length.
SIZE = 3
#: Folders of the index; a question reads those of its n-grams only.
BUCKETS = 64


def _grams(text: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def postings(tokens: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(gram, key, bucket): every run of 1 to SIZE characters of the lower-cased fields, once per key.

    A row makes some hundred postings, so a small file, which Spark reads in one task, is dealt over the cluster first.
    """
    dealt = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = [F.coalesce(_grams(F.lower(F.col(f)), n), F.array().cast("array<string>")) for f in fields for n in range(1, SIZE + 1)]
    grams = dealt.select(F.explode(F.array_distinct(F.concat(*found))).alias("gram"), F.col(key))
    return grams.withColumn("bucket", _bucket(F.col("gram")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(tokens: DataFrame, path: str, key: str, fields: Sequence[str]) -> None:
    """Write the postings in BUCKETS folders, each in order of its n-grams, so that files and row groups can be left out."""
    found = postings(tokens, key, fields)
    found.repartitionByRange(F.col("bucket"), F.col("gram"), F.col(key)).sortWithinPartitions("bucket", "gram") \
        .write.mode("overwrite").partitionBy("bucket").parquet(path)


def update_index(spark: SparkSession, path: str, stored: DataFrame, batch: DataFrame, key: str, fields: Sequence[str]) -> None:
    """Bring the index from `stored` to `batch` for the keys of the batch (one row each; a row without names removes its key).

    Only folders that hold a posting that comes or goes are written anew; doing it again changes nothing.
    """
    old = postings(stored.join(batch.select(key), key, "left_semi"), key, fields)
    new = postings(batch, key, fields)
    same = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("gram", key)]
    gone = cut_lineage(old.alias("o").join(new.alias("n"), same, "left_anti"))
    come = cut_lineage(new.alias("n").join(old.alias("o"), same, "left_anti"))
    both = gone.unionByName(come)
    # Markers of empty folders are set anew below.
    held = touched_rows(spark, path, both, ["bucket"]).where(F.col("gram") != "")
    kept = held.join(both, ["gram", key, "bucket"], "left_anti")
    # A folder whose postings are all gone would not be replaced, so it keeps a row that no question asks for.
    empty = gone.select("bucket").distinct().select(F.lit("").alias("gram"), F.lit(None).cast(batch.schema[key].dataType).alias(key), "bucket")
    # What is kept and what comes share no posting, so nothing is left to be told apart.
    write_partitions(cut_lineage(kept.unionByName(come).unionByName(empty)), path, ["bucket"])


def question_grams(question: str) -> list[str]:
    low = question.lower()
    size = min(SIZE, len(low))
    return sorted({low[i:i + size] for i in range(len(low) - size + 1)}) if low else []


def matching_keys(spark: SparkSession, path: str, question: str, key: str, kind: str = "long") -> DataFrame:
    """Keys that hold all n-grams of the question: all that match, and perhaps some that do not."""
    grams = question_grams(question)
    index = spark.read.schema(f"gram string, {key} {kind}, bucket int").parquet(path)
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    read = index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return read.groupBy(key).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams)).select(key)


def search_tokens(spark: SparkSession, path: str, tokens: DataFrame, question: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of `tokens` with the question in one of the fields, upper and lower case alike.

    The question is taken as it is (no wildcards). An empty one matches every row that has a field. The
    index names candidates, whose fields are then looked at. Fields that are NULL match nothing.
    """
    hit = reduce(or_, [F.coalesce(F.contains(F.lower(F.col(f)), F.lit(question.lower())), F.lit(False)) for f in fields])
    if not question:
        return tokens.where(hit)
    kind = tokens.schema[key].dataType.simpleString()
    return tokens.join(matching_keys(spark, path, question, key, kind), key, "left_semi").where(hit)
