"""Operator 10: quality rules, with lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import batched, rows_of, text_or_empty
from tickloom.llm.labelled import PER_CLASS, labelled_sample

SYMBOLS = str.maketrans("", "", "#*$%&|<>")
DIGITS = str.maketrans("", "", "0123456789")
SPACES = " \t\n\x0b\f\r"
ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                  ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                  ("kept", pa.bool_()), ("content_share", pa.float64())])
COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, content_share double")
#: A document stays if this share of its words is in lines of content.
LEAST_CONTENT = 0.5
#: How much the label of a document says of all its lines together (a log of odds).
PULL = 4.0
N_FEATURES = 12


def split_words(text: str) -> list[str]:
    """Runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return [w.decode() for w in text.encode().split()]


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more, first occurrences included.

    Windows are compared exactly: pairs of word numbers are renumbered, then pairs of pairs.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    two = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
    four = np.unique((two[:-2] << 32) | two[2:], return_inverse=True)[1]
    five, counts = np.unique((four[:n] << 32) | ids[width - 1:], return_inverse=True, return_counts=True)[1:]
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[five] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(text) - len(text.translate(SYMBOLS)), dup, repeated_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = split_words(line)
        n = len(words)
        if not n:
            continue
        chars = sum(map(len, words))
        bare = line.strip(SPACES)
        rows.append((
            1.0, min(np.log1p(n), 5.0) / 5, min(chars / n, 15) / 15, (len(line) - len(line.translate(SYMBOLS))) / chars,
            line.count("|") / n, line.count("!") / n, float(line.isupper()), (len(line) - len(line.translate(DIGITS))) / chars,
            len(set(words)) / n, float(bare[-1] in ".!?"), float(line in seen), sum(map(str.isalpha, (w.rstrip(".,;:") for w in words))) / n))
        sizes.append(n)
        seen.add(line)
    return np.array(rows).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


class LineField:
    """Two states, 0 boilerplate and 1 content: scores of a line's features and of neighbouring states."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.weights, self.steps, self.first = weights, steps, first

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The most likely states of a document's lines; ties go to content."""
        emitted = (rows @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = emitted[0][0] + self.first[0], emitted[0][1] + self.first[1]
        back = []
        for e0, e1 in emitted[1:]:
            from0, from1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
        states = np.empty(len(emitted), np.int64)
        state = int(b >= a)
        states[-1] = state
        for i in range(len(back) - 1, -1, -1):
            state = int(back[i][state])
            states[i] = state
        return states

    def content_share(self, text: str) -> float:
        """Share of the words that are in lines of content; 1 where there is no word."""
        rows, sizes = lines_of(text)
        return float(sizes[self.viterbi(rows) == 1].sum() / sizes.sum()) if len(sizes) else 1.0


class Sample:
    """Lines of labelled documents, laid out for forward and backward sums over all documents at once.

    Documents are sorted by length, so those still running at a line are the first ones. Lines are laid
    out by place, then document: row begins[t] + i is line t of document i, and nothing is padded.
    """

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray, int]], pull: float):
        """(features of the lines, words of the lines, mark) of documents with lines."""
        pairs = sorted(pairs, key=lambda x: -len(x[0]))
        marks = np.array([m for _, _, m in pairs])
        sizes = np.array([len(r) for r, _, _ in pairs])
        self.running = [int((sizes > t).sum()) for t in range(int(sizes[0]))]
        self.begins = np.append(0, np.cumsum(self.running))
        self.owner = np.concatenate([np.arange(k) for k in self.running])
        place = np.repeat(np.arange(len(self.running)), self.running)
        row = (np.append(0, np.cumsum(sizes))[:-1])[self.owner] + place
        self.lines = np.concatenate([r for r, _, _ in pairs])[row]
        self.at = [slice(int(self.begins[t]), int(self.begins[t + 1])) for t in range(len(self.running))]
        # Of every line but the first of a document, its own row and the row of the line before.
        self.later = np.arange(self.running[0], len(self.lines))
        self.earlier = self.begins[place[self.later] - 1] + self.owner[self.later]
        each = np.where(marks == 1, 0.5 / max(1, (marks == 1).sum()), 0.5 / max(1, (marks == 0).sum()))
        self.each = each / sizes
        # What the label says of a line: `pull` per document, dealt by the words of its lines.
        share = np.concatenate([w / w.sum() for _, w, _ in pairs])[row]
        self.hint = pull * share[:, None] * np.eye(2)[marks][self.owner]

    def sums(self, emitted: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the sum over all labellings of every document, probabilities of lines and of neighbouring lines."""
        at, running, begins = self.at, self.running, self.begins
        ahead = np.empty_like(emitted)
        ahead[at[0]] = emitted[at[0]] + first
        for t in range(1, len(at)):
            before = ahead[at[t - 1]][:running[t]]
            ahead[at[t]] = np.logaddexp(before[:, 0:1] + steps[0], before[:, 1:2] + steps[1]) + emitted[at[t]]
        behind = np.zeros_like(emitted)
        for t in range(len(at) - 2, -1, -1):
            after = behind[at[t + 1]] + emitted[at[t + 1]]
            behind[begins[t]:begins[t] + running[t + 1]] = np.logaddexp(after[:, 0:1] + steps[:, 0], after[:, 1:2] + steps[:, 1])
        total = np.logaddexp(*(ahead[at[0]] + behind[at[0]]).T)
        whole = total[self.owner]
        both = np.exp(ahead[self.earlier][:, :, None] + steps + (emitted + behind)[self.later][:, None, :] - whole[self.later, None, None])
        return total, np.exp(ahead + behind - whole[:, None]), both

    def loss(self, params: np.ndarray, decay: float, change_decay: float) -> tuple[float, np.ndarray]:
        """Minus the log of what the labels say under the field, and its slope.

        States of lines are hidden. A labelling s of a document counts exp(hint of s) times: the sum over
        all labellings with the hints, over the sum without, is what the document's label is worth.
        """
        weights, steps, first = unpacked(params)
        emitted = self.lines @ weights
        free, one, two = self.sums(emitted, steps, first)
        told, one_told, two_told = self.sums(emitted + self.hint, steps, first)
        scale = self.each[self.owner]
        surplus = (one - one_told) * scale[:, None]
        slope_s = ((two - two_told) * scale[self.later, None, None]).sum(axis=0)
        held = np.full(len(params), decay)
        held[2 * N_FEATURES:-2] = change_decay
        slope = np.concatenate([(self.lines.T @ surplus).ravel(), slope_s.ravel(), surplus[self.at[0]].sum(axis=0)]) + held * params
        return float((self.each * (free - told)).sum() + 0.5 * (held * params ** 2).sum()), slope


def unpacked(params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return params[:2 * N_FEATURES].reshape(N_FEATURES, 2), params[2 * N_FEATURES:-2].reshape(2, 2), params[-2:]


def fit(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, change_decay: float = 3e-2,
        pull: float = PULL) -> LineField:
    """A field whose lines are hidden states: labels are of documents, no line has one.

    A document's label pulls its lines towards its state, a line by its share of the words and all of
    them by `pull` together; what each line is comes out of all documents at once, so that lines of a kind
    found in good and bad documents alike go their own way within a document. Steps between states begin
    at zero and are held near it, a change up and a change down alike. All documents of a step at once
    (Adam). Without documents of both classes every line is content.
    """
    neutral = LineField(np.stack([np.zeros(N_FEATURES), np.eye(N_FEATURES)[0]], axis=1), np.zeros((2, 2)), np.zeros(2))
    pairs = [(*lines_of(t), m) for t, m in sample]
    pairs = [p for p in pairs if len(p[0])]
    if len({m for _, _, m in pairs}) < 2:
        return neutral
    held = Sample(pairs, pull)
    params = np.zeros(2 * N_FEATURES + 6)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for turn in range(1, rounds + 1):
        slope = held.loss(params, decay, change_decay)[1]
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope ** 2
        params = params - rate * (m1 / (1 - 0.9 ** turn)) / (np.sqrt(m2 / (1 - 0.999 ** turn)) + 1e-8)
    return LineField(*unpacked(params))


def quality_model(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineField:
    """A field of 30 numbers from a bounded sample of labelled documents."""
    return fit(labelled_sample(documents, labels, "quality", per_class))


def verdict(model: LineField, text: str) -> tuple:
    """The base counts, base_failed, kept and content_share of a text."""
    words = split_words(text)
    counts = base_counts(text, words)
    failed = base_failed(counts[0], counts[4])
    share = model.content_share(text)
    return *counts, failed, not failed and share >= LEAST_CONTENT, share


def judged(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    Lines are labelled content or boilerplate by Viterbi decoding over the whole document; `kept` is
    false if the base rules fail or less than LEAST_CONTENT of the words is content. A NULL text has
    no words and fails the base rules, as does an empty one; their content_share is 1. Repeated rows
    and NULL doc_ids are judged row by row. Nothing is shuffled.
    """
    model = quality_model(documents, labels, per_class)

    def made(batches):
        yield from batched(((doc_id, *verdict(model, text)) for doc_id, text in rows_of(batches)), ROWS)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(made, COLUMNS)


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they are."""
    model = quality_model(documents, labels)

    @pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([verdict(model, t)[6] for t in texts], dtype="bool")

    return documents.where(kept(text_or_empty()))
