"""Operator 13: language identification by nearest centroids of TF-IDF vectors of character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batched, rows_of, stage

#: Bounds of a fit: documents of each language, and the length of a vector of hashed n-grams.
PER_LANG, BITS = 400, 13
DIMS = 1 << BITS
#: Centroids of a language, turns of their clustering, and the share of a centroid's own learning
#: documents that lie within its distance of rejection.
CENTROIDS, TURNS, WITHIN = 4, 12, 0.995
UNDETERMINED = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Code points counted at a time, and texts scored at a time.
BLOCK, ROWS = 1 << 20, 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the documents, by the check sum of doc_id as text; a NULL doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def counts(text: str) -> np.ndarray | None:
    """Occurrences of the hashed 1- to 3-grams of the whole text, runs without letters as one space; None without a letter."""
    flat = NO_LETTERS.sub(" ", text.lower()).strip()
    if not flat:
        return None
    codes = np.frombuffer(f" {flat} ".encode("utf-32-le"), np.uint32)
    out = np.zeros(DIMS)
    for at in range(0, len(codes), BLOCK):
        part = codes[at:at + BLOCK + 2].astype(np.uint64)
        own = min(BLOCK, len(codes) - at)
        key = np.zeros(len(part), np.uint64)
        for size in (1, 2, 3):
            key = key[:len(part) - size + 1] * np.uint64(1 << 21) + part[size - 1:]
            slots = ((key[:own] + np.uint64(size)) * MIX) >> np.uint64(64 - BITS)
            out += np.bincount(slots.astype(np.int64), minlength=DIMS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Centroids:
    """Unit centroids (one row each), the language and the distance of rejection of each, and the n-gram weights."""

    idf: np.ndarray
    rows: np.ndarray
    langs: tuple[str, ...]
    reach: np.ndarray

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return unit(np.log1p(found) * self.idf).astype(np.float32)

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the cosine with it; ties go to the first in the order of languages."""
        cosines = self.vectors(found) @ self.rows.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)


def clustered(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the centroid of each vector; begins with the vectors farthest from each other."""
    centre = unit(vectors.mean(axis=0, keepdims=True))
    chosen, nearest = [], (vectors @ centre[0])
    for _ in range(min(k, len(vectors))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    rows = vectors[chosen]
    for _ in range(TURNS):
        own = (vectors @ rows.T).argmax(axis=1)
        used = np.unique(own)
        rows = unit(np.stack([vectors[own == c].mean(axis=0) for c in used]))
    return rows, (vectors @ rows.T).argmax(axis=1)


def fit(found: np.ndarray, langs: list[str], k: int = CENTROIDS, within: float = WITHIN) -> Centroids:
    """Centroids from n-gram counts (a row per document) and their languages."""
    seen = (found > 0).sum(axis=0)
    idf = np.log((1 + len(found)) / (1 + seen)) + 1
    vectors = unit(np.log1p(found) * idf)
    rows, names, reach = [], [], []
    for lang in sorted(set(langs)):
        own = vectors[[i for i, one in enumerate(langs) if one == lang]]
        centres, member = clustered(own, k)
        for c in range(len(centres)):
            distances = 1 - own[member == c] @ centres[c]
            rows.append(centres[c])
            names.append(lang)
            reach.append(float(np.quantile(distances, within)) if len(distances) else 0.0)
    return Centroids(idf, np.array(rows, np.float32).reshape(-1, DIMS), tuple(names), np.array(reach))


def learning_sample(documents: DataFrame, per_lang: int = PER_LANG) -> tuple[np.ndarray, list[str]]:
    """n-gram counts and languages of at most `per_lang` distinct documents of each language, none of them held out.

    The draw depends on doc_id and text alone: rows whose hash lies below a bound, taken from the
    language's number of rows so that some more than needed pass, then the smallest hashes. Equal
    rows count once. At most `per_lang` vectors of DIMS counts per language come to the driver.
    """
    own = documents.select(F.col("doc_id").cast("long"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    own = own.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("hash"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return np.zeros((0, DIMS)), []
    share = {lang: min(1.0, (1.5 * per_lang + 100) / n) for lang, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, int(part * 2**53))])
    drawn = stage(own.where(F.col("hash") <= bound[F.col("lang")]).groupBy("lang", "hash").agg(F.min("text").alias("text")), "drawn")
    schema = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.float64()))])

    def counted(batches):
        def made():
            for lang, number, text in rows_of(batches):
                found = counts(text)
                if found is not None:
                    slots = np.flatnonzero(found)
                    yield lang, number, slots, found[slots]
        yield from batched(made(), schema, 256)

    rows: dict[str, list] = {}
    smallest = drawn.select("lang", "hash").collect()  # 1.5 * per_lang + 100 numbers a language, expected
    for lang, number in smallest:
        rows.setdefault(lang, []).append(number)
    last = {lang: sorted(numbers)[:per_lang][-1] for lang, numbers in rows.items()}
    upto = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    kept = drawn.where(F.col("hash") <= upto[F.col("lang")]).select("lang", "hash", "text").mapInArrow(
        counted, "lang string, hash long, slots array<int>, counts array<double>")
    found, langs = [], []
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["hash"])):
        vector = np.zeros(DIMS)
        vector[r["slots"]] = r["counts"]
        found.append(vector)
        langs.append(r["lang"])
    return np.array(found).reshape(-1, DIMS), langs


def identify(documents: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, nearest (language or NULL), distance (1 - cosine), accepted for every document.

    Whole texts are compared. A text that is NULL or has no letter has no nearest language, distance
    1 and is not accepted; otherwise it is accepted if its distance is at most that within which
    nearly all learning documents of the same centroid lie. A model without languages accepts nothing.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("nearest", pa.string()), ("distance", pa.float64()), ("accepted", pa.bool_())])

    def scored(ids, found):
        known = [i for i, one in enumerate(found) if one is not None] if model.langs else []
        nearest, distance, accepted = [None] * len(ids), [1.0] * len(ids), [False] * len(ids)
        if known:
            best, cosine = model.nearest(np.stack([found[i] for i in known]))
            for i, c, close in zip(known, best.tolist(), cosine.tolist(), strict=True):
                nearest[i], distance[i], accepted[i] = model.langs[c], 1 - close, bool(1 - close <= model.reach[c])
        return pa.RecordBatch.from_arrays(
            [pa.array(column, type=field.type) for column, field in zip((ids, nearest, distance, accepted), schema, strict=True)],
            schema=schema)

    def made(batches):
        ids, found = [], []
        for doc_id, text in rows_of(batches):
            ids.append(doc_id)
            found.append(counts(text or ""))
            if len(ids) == ROWS:
                yield scored(ids, found)
                ids, found = [], []
        if ids:
            yield scored(ids, found)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        made, "doc_id long, nearest string, distance double, accepted boolean")


def predicted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance, accepted for every document.

    lang_pred is the nearest learned language, also where the distance is rejected (accepted tells);
    `und` where a text is NULL or has no letter, or where no language could be learned. score is the
    cosine with the centroid, 0 for `und`. Learned from rows that are not held out, with a doc_id, a
    lang and a letter in the text; equal rows learn once, conflicting ones all. Repeated rows give a
    row each; an empty table gives no rows.
    """
    model = fit(*learning_sample(documents))
    return identify(documents, model).select(
        "doc_id", held_out().alias("held_out"), F.coalesce("nearest", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("nearest").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("distance")))).alias("score"),
        "distance", "accepted")
