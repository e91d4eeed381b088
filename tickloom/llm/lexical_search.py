"""Operator 12: ranked lexical search over frequency-prefix trees of documents.

A document is reduced to the terms that some item asks for, ordered by how many documents hold them,
the most frequent first. The vectors of a task form tries: documents that begin with the same terms
share a path. Every node knows, for its subtree, the largest frequency of each term and the smallest
length norm, which bound the score of any document below; an item descends into the most promising
child first and leaves out what cannot enter its best rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import batched, rows_of, stage

#: Bytes that end a term: all of ASCII but digits and letters.
SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
BLANKED = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
#: Items that one pass over the documents answers; more items take more passes.
BLOCK_ITEMS = 4096
#: A tree holds at most TREE_ROWS documents and TREE_TERMS entries; documents of a node are told apart above LEAF.
TREE_ROWS, TREE_TERMS, LEAF = 32_768, 4_000_000, 48
#: Tie-break of documents without an id: after all others.
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Terms of the whole text in order, A-Z lower-cased."""
    return (text or "").encode().translate(BLANKED).lower().split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def share(frequency: np.ndarray, norm: np.ndarray | int) -> np.ndarray:
    """What a term adds per unit of weight: it grows with the frequency and falls with the norm."""
    return 1_000_000_000 * frequency // (1000 * frequency + 8 * norm)


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, terms (distinct). Rows of one item count together; a NULL text has no terms."""
    def made(batches):
        schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])
        yield from batched(((i, t) for i, words in rows_of(batches) for t in set(terms(words))), schema)

    found = items.select(F.col(item).cast("long"), F.col(text)).mapInArrow(made, "item long, term binary")
    return found.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def restricted(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms (numbers of those in `numbers`), counts; documents without a term are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def made(batches):
        def rows():
            for doc_id, text in rows_of(batches):
                found = terms(text)
                if found:
                    known = [(numbers[t], c) for t, c in Counter(found).items() if t in numbers]
                    yield doc_id, len(found), [t for t, _ in known], [c for _, c in known]
        yield from batched(rows(), schema, 2048)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        made, "doc_id long, n long, terms array<int>, counts array<long>")


@dataclass
class Node:
    """Documents low..high of a tree: the ranks they hold, the largest frequency of each, the smallest norm and doc_id.

    `share` is what each rank can add at most per unit of its weight: that of the largest frequency at the smallest norm.
    """

    low: int
    high: int
    ranks: np.ndarray
    most: np.ndarray
    share: np.ndarray
    norm: int
    first: int
    children: list[Node] = field(default_factory=list)


class DocumentTree:
    """Trie of document vectors; `ranks` of a document ascend, rank 0 being the most frequent term."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]):
        """Rows of (doc_id, norm, ranks, frequencies)."""
        paths = [r[2].astype(">i4").tobytes() for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (paths[i], rows[i][0]))
        self.ids = np.array([rows[i][0] for i in order], np.int64)
        self.norms = np.array([rows[i][1] for i in order], np.int64)
        self.paths = [rows[i][2] for i in order]
        self.starts = np.append(0, np.cumsum([len(p) for p in self.paths]))
        self.ranks = np.concatenate(self.paths) if rows else np.zeros(0, np.int64)
        self.counts = np.concatenate([rows[i][3] for i in order]) if rows else np.zeros(0, np.int64)
        self.shares = share(self.counts, np.repeat(self.norms, np.diff(self.starts)))
        self.root = self._node(0, len(rows), 0) if rows else None

    def _node(self, low: int, high: int, depth: int) -> Node:
        children = [self._node(a, b, d) for a, b, d in self._split(low, high, depth)]
        if children:
            ranks = np.concatenate([c.ranks for c in children])
            most = np.concatenate([c.most for c in children])
        else:
            ranks, most = (part[self.starts[low]:self.starts[high]] for part in (self.ranks, self.counts))
        order = np.argsort(ranks, kind="stable")
        held, at = np.unique(ranks[order], return_index=True)
        largest = np.maximum.reduceat(most[order], at) if len(at) else most
        norm = int(self.norms[low:high].min())
        return Node(low, high, held, largest, share(largest, norm), norm, int(self.ids[low:high].min()), children)

    def _split(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Children (low, high, depth) at the first position where paths part; neighbours of few documents stay together."""
        if high - low <= LEAF:
            return []
        first, last = self.paths[low], self.paths[high - 1]
        while depth < len(first) and depth < len(last) and first[depth] == last[depth]:
            depth += 1  # paths are sorted, so what the outermost share, all share
        if depth == len(last):
            return []  # one path for all
        steps = [p[depth] if depth < len(p) else -1 for p in self.paths[low:high]]
        cuts = [low + int(i) + 1 for i in np.flatnonzero(np.diff(steps))]
        runs, out = list(zip([low, *cuts], [*cuts, high], strict=True)), []
        for a, b in runs:
            if out and out[-1][1] - out[-1][0] + b - a <= LEAF:
                out[-1] = (out[-1][0], b, depth)
            else:
                out.append((a, b, depth))
        return out if len(out) > 1 else []

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
        """The best `k` of `best` and this tree as (-score, doc_id), ascending, and the number of nodes looked at.

        Depth first, the child with the largest bound before the others. A subtree is left out if its
        bound lies below the last of the best rows, or equals it where no id below could win the tie.
        """
        seen = 0
        worth = np.zeros(int(max(ranks[-1], self.ranks.max(initial=0))) + 1, np.int64)
        worth[ranks] = weights

        def bound(node: Node) -> int:
            at = node.ranks.searchsorted(ranks)
            at[at == len(node.ranks)] = 0
            return int(np.dot(weights * (node.ranks[at] == ranks), node.share[at])) if len(node.ranks) else 0

        def hopeless(limit: int, node: Node) -> bool:
            return limit <= 0 or (len(best) == k and (-limit, node.first) >= best[-1])

        stack = [(bound(self.root), self.root)] if self.root else []
        while stack:
            limit, node = stack.pop()
            seen += 1
            if hopeless(limit, node):
                continue
            if node.children:
                stack += sorted(((bound(c), c) for c in node.children), key=lambda pair: pair[0])
                continue
            scores = self.scores(node, worth)
            for i in np.flatnonzero(scores >= (-best[-1][0] if len(best) == k else 1)).tolist():
                best.append((-int(scores[i]), int(self.ids[node.low + i])))
            best.sort()
            del best[k:]
        return best, seen

    def scores(self, node: Node, worth: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf; `worth` is the item's weight of every rank."""
        low, high = self.starts[node.low], self.starts[node.high]
        sums = np.append(0, np.cumsum(worth[self.ranks[low:high]] * self.shares[low:high]))
        return np.diff(sums[self.starts[node.low:node.high + 1] - low])


def trees(rows):
    """Trees of at most TREE_ROWS documents and TREE_TERMS entries (a longer document has its own)."""
    held, entries = [], 0
    for row in rows:
        held.append(row)
        entries += len(row[2])
        if len(held) >= TREE_ROWS or entries >= TREE_TERMS:
            yield DocumentTree(held)
            held, entries = [], 0
    if held:
        yield DocumentTree(held)


def search_block(documents: DataFrame, asked: dict[int | None, list[bytes]], k: int) -> DataFrame:
    """item, doc_id, score: the best rows of every task for the items of one block, `k` at most per item."""
    numbers = {t: i for i, t in enumerate(sorted({t for words in asked.values() for t in words}))}
    vectors = stage(restricted(documents, numbers), "vectors")
    total, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A row per term that the items ask for.
    holding = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    ranked = sorted(holding, key=lambda t: (-holding[t], t))
    rank = np.full(len(numbers), -1, np.int64)
    rank[ranked] = np.arange(len(ranked))
    weights = np.array([weight(total, holding[t]) for t in ranked], np.int64)
    queries = []
    for item, words in asked.items():
        own = np.sort(np.array([rank[numbers[t]] for t in words], np.int64))
        own = own[own >= 0]
        if len(own):
            queries.append((item, own, weights[own]))
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def searched(batches):
        def rows():
            for batch in batches:
                for doc_id, n, found, counts in rows_of([batch]):
                    own = rank[np.array(found, np.int64)]
                    order = np.argsort(own)
                    yield (NO_ID if doc_id is None else doc_id, 100 - 90 + 90 * n * total // length, own[order],
                           np.array(counts, np.int64)[order])

        best = {item: [] for item, _, _ in queries}
        for tree in trees(rows()):
            for item, own, worth in queries:
                best[item], _ = tree.search(own, worth, best[item], k)
        yield from batched(((item, None if doc_id == NO_ID else doc_id, -score) for item, rows in best.items() for score, doc_id in rows),
                           schema)

    held = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")
    return held.mapInArrow(searched, "item long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of every item with a score above 0.

    Terms are maximal runs of digits, letters and anything beyond ASCII in the whole text, A-Z
    lower-cased; a NULL or empty text has none. The score sums, over the distinct terms of the item,
    weight * (1000000000 tf div (1000 tf + 8 m)), with weight = floor(1000 ln((2N + 2) / (2 df + 1)))
    and m = 10 + (90 n N) div L. Equal scores go by ascending doc_id, a NULL doc_id last. Repeated
    rows of documents each take a rank; rows of one item_id count together as one item. Empty tables
    give no rows. The items are the stated query set: a pass over the documents answers
    BLOCK_ITEMS of them.
    """
    asked = stage(item_terms(items), "items")
    blocks = max(1, math.ceil(asked.count() / BLOCK_ITEMS))
    parts = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = search_block(documents, {r["item"]: [bytes(t) for t in r["terms"]] for r in own.collect()}, k)
        parts = found if parts is None else parts.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").alias("item_id"), "rank", "doc_id", "score")


#: DuckDB text of the query: plain counting, for comparison.
ORACLE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
         g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
         q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
         p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
               WHERE term IN (SELECT term FROM q) GROUP BY ALL),
         w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
               FROM p, g GROUP BY term, n_docs),
         m AS (SELECT r, doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, g WHERE len(t) > 0),
         s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
               FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    WHERE rank <= 10"""
