"""Bounded samples of labelled documents, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stage

#: Bounds of a fit: documents of each class, and characters that all drawn documents of a class may have together.
PER_CLASS, MOST_DRAWN = 1200, 20_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, by the check sum of doc_id as text; a NULL doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS,
                    most_drawn: int = MOST_DRAWN) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most `per_class` documents of each class, none of them held out.

    The draw depends on the tables' rows alone, not on their order or layout: documents come by the hash
    of their doc_id, smallest first. A doc_id that is labelled both ways counts as 0; of several texts of
    one doc_id that with the smallest hash (then the smallest) counts. Documents of any length may be drawn; one that would take a
    class over `most_drawn` characters is passed over. It is the only part of the corpus that a fit sees,
    and it is read in one scan: rows of `labels` whose hash lies below a bound taken from their number, so
    that enough are left where some labels have no text.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    marks = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("mark")))
    sizes = dict(marks.groupBy("mark").count().collect())
    bound = {c: int(min(1.0, (3 * per_class + 200) / max(1, sizes.get(c, 0))) * 2**53) for c in (0, 1)}
    some = marks.where(place < F.when(F.col("mark") == 0, F.lit(bound[0])).otherwise(F.lit(bound[1])))
    texts = documents.select(F.col("doc_id").cast("long"), "text").where(F.char_length("text") > 0)
    # About 6 * per_class ids, whatever the size of the tables.
    found = stage(texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "mark").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("of")).select(
            "mark", place.alias("place"), "doc_id", F.char_length("of.text").alias("size"), F.col("of.text").alias("text")), "labelled")
    drawn: dict[int, list[int]] = {0: [], 1: []}
    left = {0: most_drawn, 1: most_drawn}
    for r in sorted(found.drop("text").collect(), key=lambda r: (r["place"], r["doc_id"])):
        if len(drawn[r["mark"]]) < per_class and r["size"] <= left[r["mark"]]:
            drawn[r["mark"]].append(r["doc_id"])
            left[r["mark"]] -= r["size"]
    chosen = documents.sparkSession.createDataFrame([(i,) for ids in drawn.values() for i in ids], "doc_id long")
    text_of = {r["doc_id"]: r["text"] for r in found.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text").collect()}
    return [(text_of[i], c) for c in (0, 1) for i in drawn[c]]
