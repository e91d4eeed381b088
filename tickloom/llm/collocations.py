"""Operator 11: collocations of two and three words by weighted acyclic automata of word n-grams.

Every word begins a window of up to three words that ends at its piece. The number of a phrase's
occurrences is the weight of the windows that begin with it, so one automaton of windows counts all
phrases. Shards of documents build automata from their sorted windows, prefix ranges unite those of all
shards, and parts of candidates are looked up by composing the parts asked for with the counts of a range.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import batched, rows_of, stage, text_or_empty

UNDETERMINED = "und"
#: Bytes that end a piece, as one byte that no UTF-8 text holds; of white space only blank and tab part words.
MARK = b"\xff"
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", MARK * 10 + b" ")
#: Words of a shard, words taken from a text at a time, and words that a prefix range holds on average.
SHARD_WORDS, SLICE, RANGE_WORDS = 1_000_000, 250_000, 1_500_000
#: Documents and windows drawn, on average, to place the borders of the ranges; results do not depend on them.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 400_000
#: Rows of a united automaton that are held before shards are summed.
HELD = 2_500_000
Path = tuple[bytes, bytes, bytes]


def _packed(columns: Sequence[np.ndarray], symbols: int) -> np.ndarray:
    """One ascending number per row, in the order of the columns."""
    key = columns[0].astype(np.int64)
    bits = symbols.bit_length()
    if bits * len(columns) <= 63:
        for column in columns[1:]:
            key = key << bits | column
        return key
    for column in columns[1:]:  # very many words: rows are numbered after every column
        key = np.unique(key << 32 | column, return_inverse=True)[1]
    return key


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Rows at which a run of equal values begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


@dataclass(frozen=True)
class CountAutomaton:
    """Acyclic automaton over words that accepts windows with their weights.

    Symbols are the places of `words` from 1; 0 ends a window early. The first state has an arc per
    entry of `first`, the states behind them `seconds` arcs each; these lead to the states `target`,
    which are shared: of all states whose arcs are equal in symbols and weights (up to SHARED arcs)
    there is one. State s has the arcs tail[s] .. tail[s + 1] of `third` with their `weights`.
    """

    words: list[bytes]
    first: np.ndarray
    seconds: np.ndarray
    second: np.ndarray
    target: np.ndarray
    tail: np.ndarray
    third: np.ndarray
    weights: np.ndarray

    SHARED = 4

    @classmethod
    def from_sorted(cls, words: list[bytes], columns: Sequence[np.ndarray], weights: np.ndarray) -> CountAutomaton:
        """From distinct windows (three columns of symbols) in ascending order."""
        one, two, three = columns
        ones, pairs = _starts(one), _starts(one, two)
        length = np.diff(np.append(pairs, len(one)))
        target = np.empty(len(pairs), np.int64)
        kept, states = [], 0
        for size in range(1, cls.SHARED + 1):
            own = np.flatnonzero(length == size)
            if not len(own):
                continue
            rows = pairs[own, None] + np.arange(size)
            arcs = np.ascontiguousarray(np.concatenate([three[rows], weights[rows]], axis=1).astype(np.int64))
            known = _packed([weights[rows[:, 0]], three[rows[:, 0]]], len(words) + 1) if size == 1 else arcs.view(
                np.dtype((np.void, arcs.itemsize * 2 * size))).ravel()
            at, same = np.unique(known, return_index=True, return_inverse=True)[1:]
            target[own] = states + same
            kept.append(rows[at].ravel())
            states += len(at)
        sizes = [np.full(len(k) // size, size) for k, size in zip(kept, [s for s in range(1, cls.SHARED + 1) if (length == s).any()],
                                                                  strict=True)]
        long = np.flatnonzero(length > cls.SHARED)
        target[long] = states + np.arange(len(long))
        inside = np.repeat(length > cls.SHARED, length)
        rows = np.concatenate([*kept, np.flatnonzero(inside)]).astype(np.int64)
        tail = np.append(0, np.cumsum(np.concatenate([*sizes, length[long]]))).astype(np.int64)
        counted = np.diff(np.append(np.searchsorted(pairs, ones), len(pairs)))
        return cls(words, one[ones], counted, two[pairs], target, tail, three[rows], weights[rows])

    @classmethod
    def from_paths(cls, paths: Iterable[Path], weights: Iterable[int]) -> CountAutomaton:
        """From distinct windows of words in any order."""
        paths = list(paths)
        words = sorted({w for path in paths for w in path} - {b""})
        place = {b"": 0} | {w: i + 1 for i, w in enumerate(words)}
        columns = np.array([[place[w] for w in path] for path in paths], np.int64).reshape(-1, 3).T
        order = np.argsort(_packed(columns, len(words) + 1), kind="stable")
        return cls.from_sorted(words, columns[:, order], np.fromiter(weights, np.int64, len(paths))[order])

    def windows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The windows in ascending order, as three columns, and their weights."""
        size = np.diff(self.tail)[self.target]
        ends = np.cumsum(size)
        rows = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.tail[self.target] - (ends - size), size)
        return ([np.repeat(np.repeat(self.first, self.seconds), size), np.repeat(self.second, size), self.third[rows]],
                self.weights[rows])

    def to_bytes(self) -> bytes:
        arrays = [self.first, self.seconds, self.second, self.target, self.tail, self.third, self.weights]
        text = b" ".join(self.words)
        head = np.array([len(text), *[len(a) for a in arrays]], np.int64)
        small = [a.astype(np.int32) for a in arrays[:-1]]
        return zstandard.compress(b"".join([head.tobytes(), text, *[a.tobytes() for a in small],
                                            arrays[-1].astype(np.int64).tobytes()]), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        data = zstandard.decompress(data)
        head = np.frombuffer(data, np.int64, 8)
        at = 64 + int(head[0])
        words = data[64:at].split(b" ") if head[0] else []
        arrays = []
        for i, size in enumerate(head[1:].tolist()):
            kind = np.int64 if i == 6 else np.int32
            arrays.append(np.frombuffer(data, kind, size, at).astype(np.int64))
            at += size * np.dtype(kind).itemsize
        return cls(words, *arrays)


def cut(words: list[bytes], columns: Sequence[np.ndarray], weights: np.ndarray, borders: Sequence[Path]) -> Iterator[tuple[int, CountAutomaton]]:
    """(number, automaton) of the sorted windows between ascending borders; a border belongs to what follows it."""
    cuts = [0]
    for border in borders:
        low, high = 0, len(weights)
        for column, word in zip(columns, border, strict=True):
            at = bisect_left(words, word)
            symbol = 0 if word == b"" else at + 1
            begin = low + int(np.searchsorted(column[low:high], symbol))
            if word != b"" and (at == len(words) or words[at] != word):
                low = begin
                break
            low, high = begin, low + int(np.searchsorted(column[low:high], symbol, side="right"))
        cuts.append(low)
    cuts.append(len(weights))
    for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if high > low:
            own = [c[low:high] for c in columns]
            used = np.zeros(len(words) + 1, bool)
            for column in own:
                used[column] = True
            used[0] = False
            place = np.cumsum(used) * used
            yield number, CountAutomaton.from_sorted([words[i - 1] for i in np.flatnonzero(used).tolist()],
                                                     [place[c] for c in own], weights[low:high])


def summed(parts: Sequence[CountAutomaton]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Words, and in ascending order the windows of all parts, weights of equal ones summed."""
    words = sorted({w for part in parts for w in part.words})
    place = {w: i + 1 for i, w in enumerate(words)}
    columns, weights = [[], [], []], []
    for part in parts:
        own = np.array([0, *[place[w] for w in part.words]], np.int64)
        found, weight = part.windows()
        for column, more in zip(columns, found, strict=True):
            column.append(own[more])
        weights.append(weight)
    joined, weight = [np.concatenate(c) for c in columns], np.concatenate(weights)
    order = np.argsort(_packed(joined, len(words) + 1))
    joined = [c[order] for c in joined]
    at = _starts(*joined)
    return words, [c[at] for c in joined], np.add.reduceat(weight[order], at) if len(at) else weight


def union(parts: Sequence[CountAutomaton]) -> CountAutomaton:
    return CountAutomaton.from_sorted(*summed(parts))


def compose(asked: CountAutomaton, counts: CountAutomaton) -> Iterator[tuple[Path, int]]:
    """Windows accepted by both with the weight they have in `counts`: both are walked symbol by symbol."""
    place = {w: i + 1 for i, w in enumerate(counts.words)}
    known = np.array([0, *[place.get(w, -1) for w in asked.words]], np.int64)
    wanted = asked.windows()[0]
    offered, weights = counts.windows()
    states_a, states_b = np.zeros(len(wanted[0]), np.int64), np.zeros(len(weights), np.int64)
    for column_a, column_b in zip(wanted, offered, strict=True):
        key_b = states_b * (len(place) + 2) + column_b
        states, states_b = np.unique(key_b, return_inverse=True)
        symbol = known[column_a]
        key_a = states_a * (len(place) + 2) + symbol
        at = np.minimum(np.searchsorted(states, key_a), max(0, len(states) - 1))
        states_a = np.where((states_a >= 0) & (symbol >= 0) & (states[at] == key_a), at, -1) if len(states) else np.full(len(key_a), -1)
    final = np.zeros(int(states_b.max(initial=-1)) + 1, np.int64)
    final[states_b] = weights
    names = [b"", *asked.words]
    for i in np.flatnonzero(states_a >= 0).tolist():
        yield tuple(names[int(c[i])] for c in wanted), int(final[states_a[i]])


class Numbering(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Shard:
    """Windows of the texts of one language, gathered for an automaton."""

    def __init__(self):
        self.numbers = Numbering({MARK: 0})
        self.parts: list[tuple[np.ndarray, int]] = []

    def add(self, words: list[bytes]) -> int:
        for at in range(0, len(words), SLICE):
            part = words[at:at + SLICE + 2]
            self.parts.append((np.fromiter(map(self.numbers.__getitem__, part), np.int32, len(part)), min(SLICE, len(words) - at)))
        return len(words)

    def windows(self) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """Words, and in ascending order the distinct windows with the numbers of their occurrences."""
        ids = np.concatenate([np.append(ids, np.zeros(2, np.int32)) for ids, _ in self.parts])
        own = np.concatenate([np.arange(len(ids) + 2) < n for ids, n in self.parts])[:-2]
        words = list(self.numbers)[1:]
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.zeros(len(words) + 1, np.int64)
        place[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
        ids = place[ids]
        own &= ids[:-2] > 0
        three = np.where(ids[1:-1] > 0, ids[2:], 0)
        columns = [c[own] for c in (ids[:-2], ids[1:-1], three)]
        bits = (len(words) + 1).bit_length()
        if bits * 3 <= 63:
            keys, weights = np.unique(_packed(columns, len(words) + 1), return_counts=True)
            columns = [keys >> 2 * bits, keys >> bits & (1 << bits) - 1, keys & (1 << bits) - 1]
        else:
            rows = np.lexsort(columns[::-1])
            columns = [c[rows] for c in columns]
            at = _starts(*columns)
            columns, weights = [c[at] for c in columns], np.diff(np.append(at, len(rows)))
        return [words[i] for i in order], columns, weights


def word_list(text: str) -> list[bytes]:
    """Words of the text, A-Z lower-cased, with MARK between pieces."""
    return text.encode().lower().translate(PIECES).replace(MARK, b" \xff ").split()


def shard_automata(documents: DataFrame, borders: list[tuple[str, Path]]) -> DataFrame:
    """range, lang, automaton: the windows of every shard of documents, cut at the borders."""
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("automaton", pa.binary())])

    def made(batches):
        def flushed(shards: dict[str, Shard]):
            for lang, shard in shards.items():
                if not shard.parts:
                    continue
                low = bisect_left(borders, (lang,))
                own = [path for name, path in borders[low:] if name == lang]
                for number, part in cut(*shard.windows(), own):
                    yield low + number, lang, part.to_bytes()

        def rows():
            shards, held = {}, 0
            for lang, text in rows_of(batches):
                held += shards.setdefault(lang, Shard()).add(word_list(text))
                if held >= SHARD_WORDS:
                    yield from flushed(shards)
                    shards, held = {}, 0
            yield from flushed(shards)

        yield from batched(rows(), schema, 64)

    return documents.mapInArrow(made, "range int, lang string, automaton binary")


def prefix_counts(automata: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase, f: weights of prefixes of every range, summed over all shards.

    Phrases below `least` are left out, except those at the ends of a range, which may go on in the
    next one. Size 0 counts all words of the range.
    """
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])

    def counted(lang: str, words: list[bytes], columns: list[np.ndarray], weights: np.ndarray):
        yield lang, 0, b"", int(weights.sum())
        names = [b"", *words]
        for size in (1, 2, 3):
            own = columns[size - 1] > 0
            at = _starts(*columns[:size])
            sums = np.add.reduceat(weights, at)
            kept = sums >= least
            if size < 3:
                kept[[0, -1]] = True
            for i in np.flatnonzero(kept & own[at]).tolist():
                yield lang, size, b" ".join(names[int(c[at[i]])] for c in columns[:size]), int(sums[i])

    def united(batches):
        def rows():
            last, held, size = None, [], 0
            for number, lang, data in rows_of(batches):
                if held and (number, lang) != last:
                    yield from counted(last[1], *summed(held))
                    held, size = [], 0
                last = number, lang
                held.append(CountAutomaton.from_bytes(data))
                size += len(held[-1].target)
                if size > HELD and len(held) > 1:
                    held = [union(held)]
                    size = len(held[0].target) // 2  # what is summed already must not set off every further shard
            if held:
                yield from counted(last[1], *summed(held))
        yield from batched(rows(), schema)

    partial = automata.mapInArrow(united, "lang string, size int, phrase binary, f long")
    return partial.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def place_borders(documents: DataFrame, ranges: int, share: float, words: float) -> list[tuple[str, Path]]:
    """Ascending borders (lang, window) that cut the windows into about equal ranges, from a bounded sample."""
    step = max(1, int(words * share / min(200 * ranges, SAMPLE_WINDOWS)))
    drawn = documents.where(F.shiftrightunsigned(F.xxhash64("key", "text"), 11) < int(share * 2**53)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary())])

    def picked(batches):
        def rows():
            for lang, text in rows_of(batches):
                found = [*word_list(text), MARK, MARK]
                for at in range(len(found) % step, len(found) - 2, step):
                    one, two, three = found[at:at + 3]
                    if one != MARK:
                        yield lang, one, *((b"", b"") if two == MARK else (two, b"" if three == MARK else three))
        yield from batched(rows(), schema)

    rows = sorted((r[0], (bytes(r[1]), bytes(r[2]), bytes(r[3])))
                  for r in drawn.mapInArrow(picked, "lang string, one binary, two binary, three binary").collect())
    return sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []


def _path(phrase: bytes) -> Path:
    words = phrase.split(b" ")
    return tuple((words + [b"", b""])[:3])


def part_counts(counts: DataFrame, parts: DataFrame, borders: list[tuple[str, Path]]) -> DataFrame:
    """lang, shard, part, f: the counts of the parts that each shard of candidates asks for.

    Counts and questions meet in the prefix range of the phrase, where the automaton of the parts of a
    shard is composed with that of the counts. A shard asks once for a part, so a word that ends many
    candidates costs a row per shard.
    """
    both = counts.where("size > 0").select("lang", F.lit(-1).alias("shard"), "phrase", "f").unionByName(
        parts.select("lang", "shard", F.col("part").alias("phrase"), F.lit(0).cast("long").alias("f")))
    ranged = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])
    answer = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("part", pa.binary()), ("f", pa.int64())])

    def placed(batches):
        yield from batched(((bisect_right(borders, (lang, _path(phrase))), lang, shard, phrase, f)
                            for lang, shard, phrase, f in rows_of(batches)), ranged)

    def composed(batches):
        def groups():
            last, held = None, []
            for number, lang, shard, phrase, f in rows_of(batches):
                if held and (number, lang, shard) != last:
                    yield *last, held
                    held = []
                last = number, lang, shard
                held.append((_path(phrase), f))
            if held:
                yield *last, held

        def rows():
            own, offered = None, None
            for number, lang, shard, held in groups():
                automaton = CountAutomaton.from_paths([p for p, _ in held], [f for _, f in held])
                if shard == -1:
                    own, offered = (number, lang), automaton
                elif own == (number, lang):
                    for path, f in compose(automaton, offered):
                        yield lang, shard, b" ".join(w for w in path if w), f
        yield from batched(rows(), answer)

    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (both.mapInArrow(placed, "range int, lang string, shard int, phrase binary, f long")
            .repartition(tasks, "range").sortWithinPartitions("range", "lang", "shard")
            .mapInArrow(composed, "lang string, shard int, part binary, f long"))


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(documents: DataFrame, least: int = 10, share: int = 50, best: int = 2000,
                 range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of every language.

    Texts are lower-cased in A-Z and cut into pieces at `.,;:!?` and line ends, pieces into words at
    blanks and tabs. a counts the occurrences of a phrase within pieces, overlaps included, `least` at
    fewest; l and r those of its parts at the cut with the lowest score, ties to the shorter first
    part; n all words of the language; score = floor(1000000 a a / (l r)). A phrase of two words goes
    if a candidate of three contains it and has at least `share` percent of its occurrences. Order:
    score, a, then phrase in UTF-8 bytes. A NULL lang counts as `und`, a NULL text as empty; repeated
    rows count each. Languages without a candidate, and empty tables, give no rows. `range_words`
    only sets the size of tasks.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"),
                           text_or_empty().alias("text"))
    rows, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = math.ceil(size / 6 / range_words) if rows else 1
    borders = place_borders(own, ranges, min(1.0, SAMPLE_DOCS / rows), size / 6) if ranges > 1 else []
    automata = shard_automata(own.select("lang", "text"), borders).repartitionById(len(borders) + 1, F.col("range")).sortWithinPartitions(
        "range", "lang")
    counts = stage(prefix_counts(automata, least), "counts")
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    phrase = F.col("phrase").cast("string")
    words = F.split(phrase, " ")
    longer = counts.where("size >= 2").select(
        "lang", "size", phrase.alias("phrase"), F.col("f").alias("a"), words.alias("words"),
        F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("int").alias("shard"))

    def part(first: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", first, length), " ").cast("binary")

    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    parted = longer.select("*", at).select("*", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("p")).select(
            "lang", "shard", "phrase", "size", "a", "k", "p.side", "p.part")
    found = part_counts(counts, parted.select("lang", "shard", "part").distinct(), borders)
    sides = parted.join(found, ["lang", "shard", "part"]).groupBy("lang", "phrase", "size", "a", "k").agg(
        *[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in ("l", "r")])
    scored = sides.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = longer.where("size = 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " "))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(
        (F.col("size") == 3) | F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return top.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: DuckDB text of the query: every phrase written out and counted.
ORACLE_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
         p AS MATERIALIZED (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
                            FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
         t AS (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
         x AS (SELECT lang, w AS one, one || ' ' || lead(w) OVER o AS two, two || ' ' || lead(w, 2) OVER o AS three
               FROM t WINDOW o AS (PARTITION BY p ORDER BY i)),
         f AS (SELECT lang, 1 AS size, one AS phrase, count(*) AS f FROM x GROUP BY ALL
               UNION ALL SELECT lang, 2, two, count(*) FROM x WHERE two IS NOT NULL GROUP BY ALL
               UNION ALL SELECT lang, 3, three, count(*) FROM x WHERE three IS NOT NULL GROUP BY ALL),
         n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
         c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 10),
         k AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
               FROM c, range(1, 3) t(k) WHERE k < size),
         s AS (SELECT k.lang, k.size, k.phrase, a, k, x.f AS l, y.f AS r,
                      (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
               FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head AND x.size = k.k
                      JOIN f y ON y.lang = k.lang AND y.phrase = k.rest AND y.size = k.size - k.k),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         m AS (SELECT lang, phrase, max(a) AS most FROM (
                   SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3
                   UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank,
               b.phrase, b.a, l, r, n, score
        FROM b JOIN n USING (lang) LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
        WHERE b.size = 3 OR most IS NULL OR 100 * most < 50 * b.a) WHERE rank <= 2000"""
