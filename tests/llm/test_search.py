"""Collocations, lexical search and language identification against brute force and held-out languages."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations, language_id, lexical_search
from tickloom.llm.collocations import CountAutomaton, Shard, compose, cut, summed, union, word_list
from tickloom.llm.common import table
from tickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- collocations -------------------------------------------------------------------------------------------

def phrases_by_hand(docs, least, best=2000):
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for size in (1, 2, 3):
                own.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            if any(f[longer] >= least and 100 * f[longer] >= 50 * a and phrase in (longer[:2], longer[1:])
                   for longer in f if len(longer) == 3 and len(phrase) == 2):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                                        for k in range(1, len(phrase)))
            scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


PIECES = [("en", "New York, new york. New  York\tcity new york city"), ("en", None), ("en", ""), (None, "a b a b a b"), ("und", "a b"),
          ("de", "x x x x x x x"), ("de", "Straße\x0bstraße der \x01 der \x01"), ("fr", ".,;:!?\n \t"),
          ("en", "New York, new york. New  York\tcity new york city"), ("", "no no no no")]


@pytest.mark.parametrize("range_words", [4_000_000, 3])
def test_collocations_by_hand(spark, range_words, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 5)
    docs = spark.createDataFrame([(i, lang, text, "score", 1) for i, (lang, text) in enumerate(PIECES)],
                                 "doc_id long, lang string, text string, phrase string, f long").repartition(3)
    got = rows(collocations.collocations(docs, least=2, range_words=range_words))
    assert got == phrases_by_hand(PIECES, 2)
    assert {r[6] for r in got if r[0] == "und"} == {8}  # a NULL lang and the lang `und` are one


@pytest.mark.parametrize("range_words", [4_000_000, 500])
def test_collocations_of_the_table(spark, range_words):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(con.execute(collocations.ORACLE_SQL).fetchall(), key=repr)
    got = rows(collocations.collocations(table(spark, SF, "documents").repartition(5), range_words=range_words))
    assert got == expected and len(got) > 100


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert rows(collocations.collocations(empty)) == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(big + 11).alias("r"))
    assert row.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * big * big // ((big + 7) * (big + 11))


def automaton_of(text):
    shard = Shard()
    shard.add(word_list(text))
    return CountAutomaton.from_sorted(*shard.windows())


def windows_of(automaton):
    names = [b"", *automaton.words]
    columns, weights = automaton.windows()
    return {tuple(names[int(c[i])] for c in columns): int(w) for i, w in enumerate(weights)}


def test_automata_store_unite_cut_and_compose():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefg"), 300)) + ". " + " ".join(rng.choice(["uv", "w"], 40)) for _ in range(4)]
    parts = [automaton_of(t) for t in texts]
    whole = automaton_of(". ".join(texts))
    assert windows_of(union(parts)) == windows_of(whole)
    assert windows_of(CountAutomaton.from_bytes(whole.to_bytes())) == windows_of(whole)
    # Equal states are one: far fewer states than pairs of words that lead to them.
    tails = automaton_of(". ".join(f"{x} {y} end" for x in "abcdef" for y in "uvw"))
    assert len(tails.tail) - 1 == 3 and len(tails.target) == 6 * 3 + 3 + 1
    borders = [(b"b", b"", b""), (b"c", b"c", b"a"), (b"c", b"cc", b""), (b"w", b"w", b"w"), (b"zz", b"", b"")]
    got = dict(cut(*summed(parts), borders))
    united = {}
    for number, part in got.items():
        for path, weight in windows_of(part).items():
            assert (number == 0 or borders[number - 1] <= path) and (number == len(borders) or path < borders[number])
            united[path] = weight
    assert united == windows_of(whole)
    asked = CountAutomaton.from_paths([(b"a", b"b", b""), (b"nowhere", b"", b""), *list(windows_of(whole))[:50]], [0] * 52)
    assert dict(compose(asked, whole)) == {p: w for p, w in windows_of(whole).items() if p in windows_of(asked)}


def test_long_texts_are_taken_in_slices(monkeypatch):
    text = " ".join(str(i % 7) for i in range(1000)) + ", end"
    whole = windows_of(automaton_of(text))
    monkeypatch.setattr(collocations, "SLICE", 13)
    assert windows_of(automaton_of(text)) == whole


# ---- lexical search -----------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def found_by_hand(docs, items, k=10):
    read = [(doc_id, Counter(TERM.findall((text or "").translate(UPPER)))) for doc_id, text in docs]
    read = [(doc_id, c) for doc_id, c in read if c]
    total, length = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, words in asked.items():
        scored = []
        for doc_id, c in read:
            m = 100 - 90 + 90 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in words if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, doc_id, -score) for i, (score, _, _, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_of_the_table(spark, sample_rows):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = rows(QUERIES["op12_lexical_search"][0](spark, SF))
    assert got == found_by_hand(sample_rows, items) and len(got) >= 10 * len(items) - 10


def test_search_edges(spark, docs_of, edge_rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", 2)
    docs = [*edge_rows, *[(100 + i, "same Words here") for i in range(30)], *[(200 + i % 3, "zebra " * (i % 4) + "word") for i in range(25)]]
    items = [(1, "ONE b?d"), (1, "zebra"), (2, None), (3, ""), (4, "same here word"), (None, "straße 日本語"), (5, "absent")]
    asked = spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id long, text string, doc_id int, rank int")
    assert rows(lexical_search.search(docs_of(docs), asked)) == found_by_hand(docs, items)
    assert rows(lexical_search.search(docs_of(docs), asked, k=2)) == found_by_hand(docs, items, 2)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    assert rows(lexical_search.search(docs_of(docs), asked)) == found_by_hand(docs, items)
    assert rows(lexical_search.search(docs_of(docs).limit(0), asked)) == []
    assert rows(lexical_search.search(docs_of(docs), asked.limit(0))) == []


def test_bounds_hold_and_branches_are_left_out():
    rng = np.random.default_rng(3)
    weights = np.sort(rng.integers(1, 9000, 300))
    vectors = []
    for i in range(3000):
        ranks = np.unique((300 * rng.random(40) ** 2).astype(np.int64))
        vectors.append((i, int(rng.integers(10, 400)), ranks, rng.integers(1, 9, len(ranks))))
    tree = lexical_search.DocumentTree(vectors)

    def nodes(node):
        yield node
        for child in node.children:
            yield from nodes(child)

    every = list(nodes(tree.root))
    own = np.sort(rng.choice(300, 12, replace=False))
    worth = np.zeros(300, np.int64)
    worth[own] = weights[own]
    exact = {doc_id: int((worth[r] * lexical_search.share(c, m)).sum()) for doc_id, m, r, c in vectors}
    for node in every:
        limit = int((worth[node.ranks] * node.share).sum())
        assert limit >= max(exact[int(i)] for i in tree.ids[node.low:node.high])
    best, seen = tree.search(own, weights[own], [], 10)
    assert best == sorted((-s, i) for i, s in exact.items())[:10]
    assert len(every) > 50 and seen <= len(every)
    # What another tree has found already leaves whole branches out.
    assert tree.search(own, weights[own], [(-10**15, 0)] * 10, 10)[1] == 1


# ---- language identification --------------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    learn = [(i, t * 3, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de")] * 12)]
    odd = [(100, None, "en"), (101, "", "en"), (102, " 12 !? _ ٣", "de"), (103, "the garden", None), (103, "der Garten und das Haus", None),
           (None, "and the house", "xx"), (104, "日本語", None), (105, "the house " * 30_000, None), (105, "the house " * 30_000, None)]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "q") for i, t, lang in learn + odd],
                                 "doc_id long, text string, lang string, score double, nearest string")
    got = [tuple(r) for r in language_id.predicted(docs.repartition(4)).collect()]
    assert len(got) == len(learn + odd)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    assert all(by_id[i][0][2:6] == ("und", 0.0, 1.0, False) for i in (100, 101, 102))
    assert sorted(r[2] for r in by_id[103]) == ["de", "en"] and by_id[None][0][2] == "en"
    assert [r[2] for r in by_id[105]] == ["en", "en"]
    # What no learned language resembles is rejected, and named all the same.
    assert by_id[104][0][2] in ("de", "en") and not by_id[104][0][5]
    assert rows(language_id.predicted(docs.limit(0))) == []
    nothing = language_id.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_model_does_not_hang_on_the_layout(spark):
    docs = table(spark, SF, "documents")
    one, three = (language_id.fit(*language_id.learning_sample(d, 20)) for d in (docs.coalesce(1), docs.repartition(3)))
    assert one.langs == three.langs and np.array_equal(one.rows, three.rows) and np.array_equal(one.reach, three.reach)


def test_languages_by_plain_counting():
    """The vector of a text, its cosine and its centroid from plain dictionaries."""
    texts = ["Das Haus 12 und der Garten.", "the house — and the garden", "la casa y el jardín", "x", "der die das und"]
    found = np.stack([language_id.counts(t) for t in texts])
    langs = ["de", "en", "es", "en", "de"]
    model = language_id.fit(found, langs, k=1)
    grams = []
    for t in texts:
        flat = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        grams.append(Counter(flat[i:i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)))
    df = Counter(g for c in grams for g in c)
    vectors = [{g: math.log1p(x) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, x in c.items()} for c in grams]
    vectors = [{g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for v in vectors]
    centre = Counter()
    for v in (vectors[0], vectors[4]):
        centre.update(v)
    length = math.sqrt(sum(x * x for x in centre.values()))
    expected = sum(x * centre[g] / length for g, x in vectors[0].items())
    best, cosine = model.nearest(found[:1])
    assert model.langs[int(best[0])] == "de" and cosine[0] == pytest.approx(expected, abs=0.02)
