"""Operator 3: word-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word. BPE would have chosen them if and only if every
adjacent pair is compatible: the merges, run on the two tokens' characters alone, give back just
these two tokens. The pairs of all new words of a batch are tested at once against a table of known
verdicts. Only words with an incompatible pair go through the exact merges.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import rows_of, text_or_empty

FILE = "word_bpe_49k.json"
CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                   ("decoded_sha256", pa.string())])
#: Separators that Python counts as white space and the vocabulary's split does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
NEVER = 1 << 40
#: Words of more characters are merged one by one.
LONG = 64


def byte_stand_ins() -> dict[int, str]:
    """Byte -> printable character of a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for a sigma at the end of a word."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordBpe:
    """The rules of a tokenizer file with word ends; chunks of text recur, so their codes are kept."""

    def __init__(self, path: str, limit: int = 250_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.texts = {i: str(i) for i in self.tokens}
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.by_pair = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.pad = len(self.tokens)
        keys = np.array([a * (self.pad + 1) + b for a, b, _ in merges], np.int64)
        self.merge_ranks = np.argsort(keys)
        self.merge_keys = keys[self.merge_ranks]
        self.merge_results = np.array([c for _, _, c in merges], np.int64)
        self.longest = max(map(len, self.vocab))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.marks = regex.compile("|".join(map(regex.escape, self.special)))
        self.stand_in = str.maketrans({chr(b): c for b, c in byte_stand_ins().items()})
        self.limit = limit
        self.pairs = np.zeros(0, np.int64)  # sorted a * n + b of the pairs with a verdict
        self.fits = np.zeros(0, bool)
        #: words: byte-level word -> ids; chunks: text between white space -> (count, ids, decoded).
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        #: What was known before the tables were last renewed: frequent entries come back from here.
        self.old_words: dict[str, list[int]] = {}
        self.old_chunks: dict[str, tuple[int, str, str]] = {}
        self.exact = 0

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair key; NEVER where there is none."""
        at = np.searchsorted(self.merge_keys, keys)
        at[at == len(self.merge_keys)] = 0
        return np.where(self.merge_keys[at] == keys, self.merge_ranks[at], NEVER)

    def merged(self, words: list[list[int]]) -> list[list[int]]:
        """The exact merges of many symbol sequences: lowest rank first, leftmost first among equals.

        All sequences of a like length advance together, one merge each per step; a merge changes the
        ranks of two neighbouring pairs only.
        """
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            width = len(words[order[at]])
            if width > LONG:
                out[order[at]] = self.merged_long(words[order[at]])
                at += 1
                continue
            stop = at
            while stop < len(order) and len(words[order[stop]]) <= min(width + 3, LONG):
                stop += 1
            group, n, at = order[at:stop], self.pad + 1, stop
            width = len(words[group[-1]])
            grid = np.full((len(group), width + 1), self.pad, np.int64)
            for row, i in enumerate(group):
                grid[row, :len(words[i])] = words[i]
            rows = np.arange(len(group))
            ranks = self.rank_of(grid[:, :-1] * n + grid[:, 1:])
            final: list = [None] * len(group)
            while len(rows):
                if ranks.shape[1]:
                    where = ranks.argmin(axis=1)
                    least = ranks[np.arange(len(rows)), where]
                    ended = least == NEVER
                else:
                    ended = np.ones(len(rows), bool)
                for k in np.flatnonzero(ended).tolist():
                    final[rows[k]] = grid[k]
                going = ~ended
                rows, grid, ranks, where, least = rows[going], grid[going], ranks[going], where[going], least[going]
                if not len(rows):
                    break
                each, columns = np.arange(len(rows)), np.arange(grid.shape[1] - 1)
                grid = np.take_along_axis(grid, columns + (columns > where[:, None]), axis=1)
                grid[each, where] = self.merge_results[least]
                columns = columns[:-1]
                ranks = np.take_along_axis(ranks, columns + (columns >= where[:, None]), axis=1)
                for side, ok in ((where - 1, where > 0), (where, where < ranks.shape[1])):
                    k, c = each[ok], side[ok]
                    ranks[k, c] = self.rank_of(grid[k, c] * n + grid[k, c + 1])
            for k, i in enumerate(group):
                out[i] = [x for x in final[k].tolist() if x != self.pad]
        return out

    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same for one very long word, by a queue of pairs over linked symbols."""
        n, symbols = len(symbols), list(symbols)
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        alive = [True] * n

        def pair(i: int):
            found = self.by_pair.get((symbols[i], symbols[right[i]])) if right[i] >= 0 else None
            return found and (found[0], i, symbols[i], symbols[right[i]], found[1])

        queue = [p for p in map(pair, range(n)) if p]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, result = heapq.heappop(queue)
            j = right[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], right[i] = result, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(queue, p)
        return [x for x, there in zip(symbols, alive, strict=True) if there]

    def symbols(self, token: str) -> list[int]:
        """Ids of a token's characters; the word end belongs to its last one."""
        if token.endswith(self.end) and len(token) > len(self.end):
            stem = token[:-len(self.end)]
            return [*map(self.vocab.__getitem__, stem[:-1]), self.vocab[stem[-1] + self.end]]
        return [*map(self.vocab.__getitem__, token)]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match; the word end counts as part of the last token only."""
        out, i, n, vocab = [], 0, len(word), self.vocab
        while i < n:
            found = vocab.get(word[i:] + self.end) if n - i <= self.longest else None
            if found is not None:
                out.append(found)
                break
            for stop in range(min(n - 1, i + self.longest), i, -1):
                found = vocab.get(word[i:stop])
                if found is not None:
                    break
            out.append(found)
            i = stop
        return out

    def verified(self, words: list[str]) -> None:
        """Put the ids of new words into `words`."""
        proposals = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] * len(self.tokens) + flat[1:])[inner]
        wrong = set(owner[1:][inner][~self.compatible(keys)].tolist())
        self.words.update(zip(words, proposals, strict=True))
        again = [words[i] for i in wrong]
        self.exact += len(again)
        self.words.update(zip(again, self.merged([self.symbols(w + self.end) for w in again]), strict=True))

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair whether the merges keep it apart; unknown pairs are tried once."""
        fresh = np.setdiff1d(keys, self.pairs)
        if len(fresh):
            pairs = [[*divmod(k, len(self.tokens))] for k in fresh.tolist()]
            joined = self.merged([self.symbols(self.tokens[a]) + self.symbols(self.tokens[b]) for a, b in pairs])
            verdicts = np.fromiter(map(list.__eq__, joined, pairs), bool, len(fresh))
            if len(self.pairs) > 4 * self.limit:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                return self.compatible(keys)
            at = np.searchsorted(self.pairs, fresh)
            self.pairs, self.fits = np.insert(self.pairs, at, fresh), np.insert(self.fits, at, verdicts)
        return self.fits[np.searchsorted(self.pairs, keys)]

    def split_words(self, chunk: str) -> list[str]:
        """Byte-level words of a chunk; letters alone are one word, ASCII stands for itself."""
        words = [chunk] if chunk.isalpha() else self.split.findall(chunk)
        return words if chunk.isascii() and chunk.isprintable() else [w.encode().decode("latin-1").translate(self.stand_in) for w in words]

    def learn(self, chunks: set[str]) -> None:
        """Codes of chunks that are not known yet, in one go."""
        if len(self.words) > self.limit:
            self.words, self.old_words = {}, self.words
        parts = {c: self.split_words(c) for c in chunks}
        new = {w for ws in parts.values() for w in ws}.difference(self.words)
        again = new & self.old_words.keys()
        self.words.update({w: self.old_words[w] for w in again})
        self.verified(list(new - again))
        known, texts, tokens = self.words, self.texts, self.tokens
        for chunk, words in parts.items():
            ids = known[words[0]] if len(words) == 1 else [i for w in words for i in known[w]]
            self.chunks[chunk] = (len(ids), " ".join([texts[i] for i in ids]), " ".join([tokens[i] for i in ids]))

    def fragments(self, text: str) -> list[tuple[bool, list[str]]]:
        """(is a special token, chunks): special tokens are found before anything is normalised."""
        out, last = [], 0
        for found in self.marks.finditer(text) if "<|" in text else ():
            out += [(False, self.chunked(text[last:found.start()])), (True, [found[0]])]
            last = found.end()
        return [*out, (False, self.chunked(text[last:]))]

    @staticmethod
    def chunked(text: str) -> list[str]:
        text = lowered(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
        return regex.split(r"\s+", text) if ODD_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text."""
        split = [self.fragments(t) for t in texts]
        wanted = {c for fragments in split for special, chunks in fragments if not special for c in chunks}
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > self.limit:
            self.chunks, self.old_chunks, new = {}, self.chunks, wanted
        again = new & self.old_chunks.keys()
        self.chunks.update({c: self.old_chunks[c] for c in again})
        if new - again:
            self.learn(new - again)
        out = []
        for fragments in split:
            codes = []
            for special, chunks in fragments:
                if special:
                    codes += [(1, str(self.special[c]), c) for c in chunks]
                else:
                    codes += map(self.chunks.__getitem__, chunks)
            sizes, ids, tokens = zip(*[c for c in codes if c[0]], strict=True) if any(c[0] for c in codes) else ((), (), ())
            out.append((sum(sizes), " ".join(ids), " ".join(tokens)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens stand apart by a space."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker."""
    return WordBpe(path)


def coded_documents(documents: DataFrame, tokenizer: str | None = None, texts: int = 128) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Texts are encoded without added tokens (the strings of special tokens become those tokens) and
    the ids decoded with special tokens kept. The hashes are of the decimal ids joined by one space
    and of the decoded text. A NULL text counts as empty: 0 tokens and hashes of the empty string.
    NULL doc_ids and repeated rows are kept row by row. Nothing is shuffled; `texts` at a time are
    in work.
    """
    tokenizer = tokenizer or public_tokenizers.path(FILE)

    def coded(batches):
        coder = word_bpe(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, texts):
                part = batch.slice(at, texts)
                ids = [row[0] for row in rows_of(iter([part.select(["doc_id"])]))]
                # Nothing here makes reference cycles; looking for them among the kept codes costs a fifth of the time.
                gc.disable()
                try:
                    codes = coder.encode_batch(part.column("text").to_pylist())
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([c[0] for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c[1].encode()).hexdigest() for c in codes], pa.string()),
                    pa.array([hashlib.sha256(c[2].encode()).hexdigest() for c in codes], pa.string())], schema=CODES)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
