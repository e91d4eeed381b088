"""Operator 4: toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import text_or_empty
from tickloom.llm.labelled import PER_CLASS, held_out, labelled_sample

WORD = re.compile(r"[^\W_]+")
#: Rows and width of the embedding, words of a passage, lengths of character n-grams.
BUCKETS, WIDTH, PASSAGE, GRAMS = 1 << 17, 8, 4, (3, 4, 5, 6)
#: Subwords of fewer documents of the sample keep a zero vector: they would be learnt by heart.
LEAST_DOCUMENTS = 3
KNOWN_LIMIT = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, ends marked."""
    marked = f"<{word}>"
    whole = marked.encode()
    size = len(marked)
    if len(whole) == size:  # ASCII: bytes are characters
        parts = [whole[i:i + n] for n in GRAMS if n < size for i in range(size - n + 1)]
    else:
        parts = [marked[i:i + n].encode() for n in GRAMS if n < size for i in range(size - n + 1)]
    return [zlib.crc32(part) % BUCKETS for part in (whole, *parts)]


def passages(values: np.ndarray) -> np.ndarray:
    """Means of PASSAGE neighbours (of all, if they are fewer)."""
    sums = np.cumsum(values)
    if len(values) <= PASSAGE:
        return sums[-1:] / len(values)
    sums = np.append(0.0, sums)
    return (sums[PASSAGE:] - sums[:-PASSAGE]) / PASSAGE


class Toxicity:
    """Probability of the toxic class for a bag: softmax of (mean of subword vectors) times weights plus bias.

    A passage is the mean of its words, a word the mean of its subwords. As the last layer is linear,
    a word adds one number to a passage, which is kept for words met before. A document scores as its
    worst passage, so a long clean text around an insult does not hide it.
    """

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.known: dict[str, float] = {}
        self.part = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64)

    def __reduce__(self):
        return Toxicity, (self.vectors, self.weights, self.bias)

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= KNOWN_LIMIT:
                self.known = {}
            found = features(word)
            value = self.known[word] = float(self.part[found].sum()) / len(found)
        return value

    def base(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def margins(self, words: list[str]) -> np.ndarray:
        """Log odds of every passage of PASSAGE words (of all words, if they are fewer)."""
        if not words:
            return np.array([min(self.base(), -4.0)])
        return self.base() + passages(np.fromiter(map(self.word, words), np.float64, len(words)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margins(words_of(text)).max(), -40, 40))))


def step_of(rows: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """A batch laid out for sums by bag and by subword: ids, shares, bags, order by id, places where an id begins, its ids, target.

    Every bag ends with one row of share zero, so that none is empty.
    """
    ids = np.concatenate([np.append(i, 0) for i, _ in rows])
    share = np.concatenate([np.append(x, 0.0) for _, x in rows])
    sizes = np.array([len(i) + 1 for i, _ in rows])
    order = np.argsort(ids, kind="stable")
    touched, begins = np.unique(ids[order], return_index=True)
    return ids, share[:, None], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes), order, begins, touched, np.eye(2)[marks]


def fit_bags(bags: list[np.ndarray], found: list[np.ndarray], marks: np.ndarray, active: np.ndarray, epochs: int = 12, rate: float = 0.3, seed: int = 7) -> Toxicity:
    """Embedding and softmax by joint gradient steps (Adagrad) over small batches of passages.

    A bag holds numbers of words, `found` the buckets of every word. Batches are drawn anew
    in every epoch. Subwords that are not active have a zero vector that never moves; they count in a
    word's mean and take no part in the steps.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    vectors[~active] = 0
    weights, bias = rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
    seen, seen_w, seen_b = np.full(BUCKETS, 1e-6), 1e-6, 1e-6
    table = {w: (found[w][active[found[w]]], 1 / len(found[w])) for w in {w for bag in bags for w in bag.tolist()}}
    rows = []
    for bag in bags:
        parts = [table[w] for w in bag.tolist()]
        rows.append((np.concatenate([i for i, _ in parts]), np.concatenate([np.full(len(i), x / len(parts)) for i, x in parts])))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            ids, share, bag_begins, owner, order, begins, touched, target = step_of([rows[i] for i in some], marks[some])
            hidden = np.add.reduceat(vectors[ids] * share, bag_begins)
            logits = hidden @ weights + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True) - target
            slope = np.add.reduceat(((error @ weights.T)[owner] * share)[order], begins) * active[touched, None]
            seen[touched] += (slope ** 2).mean(axis=1)
            vectors[touched] -= rate * slope / np.sqrt(seen[touched])[:, None]
            slope_w, slope_b = hidden.T @ error / len(error), error.mean(axis=0)
            seen_w, seen_b = seen_w + (slope_w ** 2).mean(), seen_b + (slope_b ** 2).mean()
            weights = weights - rate * 0.3 * slope_w / np.sqrt(seen_w)
            bias = bias - rate * 0.3 * slope_b / np.sqrt(seen_b)
    return Toxicity(vectors.astype(np.float32), weights, bias)


def fit(sample: list[tuple[str, int]], turns: int = 3) -> Toxicity:
    """Fit on passages: of a toxic document its worst one, of a clean document its worst and some others.

    The first choice of passages goes by the log odds of subwords over documents, later ones by the
    model itself. Without documents of both classes the model scores everything at 0.018.
    """
    numbers: dict[str, int] = {}
    texts = [(np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64), m) for t, m in sample]
    texts = [(w, m) for w, m in texts if len(w)]
    if len({m for _, m in texts}) < 2:
        return Toxicity(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 2)), np.array([4.0, 0.0]))
    found = [np.array(features(w), np.int32) for w in numbers]
    sizes = np.array([len(x) for x in found])
    flat, starts = np.concatenate(found), np.cumsum(sizes) - sizes
    counts, totals = np.zeros((2, BUCKETS), np.int64), [sum(m == c for _, m in texts) for c in (0, 1)]
    for words, mark in texts:
        counts[mark, np.concatenate([found[w] for w in set(words.tolist())])] += 1
    active = counts.sum(axis=0) >= LEAST_DOCUMENTS
    odds = np.where(counts[1] >= LEAST_DOCUMENTS, np.log((counts[1] + 0.1) / (totals[1] + 1)) - np.log((counts[0] + 1) / (totals[0] + 1)), -9.0)
    first = np.maximum.reduceat(odds[flat], starts)
    rng = np.random.default_rng(3)
    model = None
    for _ in range(turns):
        bags, marks = [], []
        values = None if model is None else np.add.reduceat(model.part[flat], starts) / sizes
        for words, mark in texts:
            if values is None:
                at = int(first[words].argmax()) - PASSAGE // 2
                places = [max(0, min(at, len(words) - PASSAGE))]
            else:
                margins = passages(values[words])
                places = [int(margins.argmax())]
                if mark == 0:  # another bad one, well apart from the worst
                    margins[max(0, places[0] - PASSAGE):places[0] + PASSAGE] = -np.inf
                    places += [int(margins.argmax())] * bool(np.isfinite(margins).any())
            if mark == 0:
                places += rng.integers(0, max(1, len(words) - PASSAGE + 1), 2).tolist()
            bags += [words[at:at + PASSAGE] for at in places]
            marks += [mark] * len(places)
        model = fit_bags(bags, found, np.array(marks), active)
    return model


def toxicity_model(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Toxicity:
    """A model of bounded size (BUCKETS * WIDTH numbers) from a bounded sample outside the held-out fold."""
    return fit(labelled_sample(documents, labels, "toxic", per_class))


def scored(spark, model: Toxicity, text: Column) -> Column:
    """The score of each whole text as a column; the model is broadcast, 2 MB whatever the corpus."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(t) for t in texts], dtype="float64")

    return score(text)


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Only the text enters a score. Labels come from rows outside the held-out fold (crc32 of doc_id as
    text, mod 5, is not 0). NULL and empty texts, and texts without letters and digits, get a low
    score. Rows are scored one by one, so repeated rows and NULL doc_ids stay as they are.
    """
    model = toxicity_model(documents, labels, per_class)
    return documents.select("doc_id", held_out().alias("held_out"),
                            scored(documents.sparkSession, model, text_or_empty()).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    model = toxicity_model(documents, labels)
    return documents.where(scored(documents.sparkSession, model, text_or_empty()) < 0.5)
