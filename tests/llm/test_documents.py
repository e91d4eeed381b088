"""Sharding, fingerprints, near copies, archives, toxicity, quality and the pipeline against plain Python."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import doc_fingerprints, packing, permute, quality_crf, sharding, simhash_dedup, toxicity, warc
from tickloom.llm.common import filesystem, new_folder, table
from tickloom.llm.components import components
from tickloom.llm.labelled import labelled_sample


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4099])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(permute.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    if n > 1000:
        assert got != list(range(n))


def test_shards(docs_of, edge_rows, sample_rows):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_rows]
    got = sharding.shard_documents(docs_of(rows), 24).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs_of(rows[::-1]), 24).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.shard_documents(docs_of([]), 24).count() == 0


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs_of, edge_rows, sample_rows):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_rows[:120]]
    got = simhash_dedup.near_duplicates(docs_of(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    names = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and names[a] != names[b]:
            old, new = names[a], names[b]
            names = [new if x == old else x for x in names]
    least = {}
    for (doc_id, _), name in zip(rows, names, strict=True):
        if doc_id is not None:
            least[name] = min(least.get(name, doc_id), doc_id)
    want = [(doc_id, f"{p:016x}", least.get(name)) for (doc_id, _), p, name in zip(rows, prints, names, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(docs_of([])).count() == 0


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base[:400]]
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    bits = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64)]))
    plan = simhash_dedup.tree(bits, 3, 100)
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shards = simhash_dedup.shards_of(bits, plan, 3)
    assert len(shards) > 2
    for _, rows in shards:
        least = simhash_dedup.linked(bits[rows], 3)
        for k, m in enumerate(least):
            a, b = root(rows[k]), root(rows[m])
            parent[max(a, b)] = min(a, b)
    want = list(range(len(bits)))
    for a in range(len(bits)):
        for b in np.flatnonzero(np.bitwise_count(bits[a + 1:] ^ bits[a]) <= 3) + a + 1:
            old, new = want[b], want[a]
            if old != new:
                want = [new if x == old else x for x in want]
    assert [root(i) for i in range(len(bits))] == [min(j for j in range(len(bits)) if want[j] == want[i]) for i in range(len(bits))]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_one_of_each_keeps_a_single_row(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "quite other words stand here now"), (None, "a b c d e f")]
    kept = simhash_dedup.one_of_each(docs_of(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, None]
    assert kept.columns == docs_of(rows).columns


def test_document_fingerprints(docs_of, edge_rows, sample_rows, monkeypatch):
    monkeypatch.setattr(doc_fingerprints, "BLOCK_BYTES", 60_000)
    rows = [(i, t) for i, t in {i: t for i, t in edge_rows}.items() if i is not None] + [(1000 + i, t) for i, t in sample_rows]
    got = {r["doc_id"]: r for r in doc_fingerprints.fingerprint_documents(docs_of(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    prints = {}
    for (doc_id, text), (after, next_text) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (
            len(text), hashlib.sha256((text[:len(text) - half] + next_text[:half]).encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        apart = (int(r["fingerprint"], 16) ^ int(got[after]["fingerprint"], 16)).bit_count()
        assert r["near_next"] == pytest.approx(max(0, math.cos(math.pi * apart / 64)))
    assert got[1]["fingerprint"] == "0" * 16
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.8


def test_document_fingerprints_of_one_and_none(docs_of):
    r, = doc_fingerprints.fingerprint_documents(docs_of([(4, "ab cd")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    assert doc_fingerprints.fingerprint_documents(docs_of([])).count() == 0
    assert doc_fingerprints.fingerprint_documents(docs_of([(None, "x y"), (None, "x y"), (3, None)])).count() == 3


def test_block_tables_find_all_within_the_radius(spark):
    rnd = random.Random(2)
    bits = [rnd.getrandbits(64) - (1 << 63) for _ in range(150)]
    bits += [b ^ (1 << i) ^ (1 << j) ^ 1 for b, i, j in zip(bits[:60], range(1, 61), range(2, 62), strict=False)]
    bits = [b if b < 1 << 63 else b - (1 << 64) for b in bits] + bits[:5] + [None]
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    got = {(r["query"], r["bits"], r["distance"]) for r in doc_fingerprints.within_radius(df, df, 3).collect()}
    known = {b for b in bits if b is not None}
    mask = (1 << 64) - 1
    assert got == {(a, b, ((a ^ b) & mask).bit_count()) for a in known for b in known if ((a ^ b) & mask).bit_count() <= 3}


def test_inflation_is_bounded_by_the_step():
    """A payload that shrinks a thousandfold, and members of every size, in steps."""
    plain = [b"x" * 50_000_000, b"", b"one\ntwo\n", random.Random(1).randbytes(700_000), b"y" * (warc.STEP - 4), b"z" * warc.STEP, b"end"]
    packed = b"".join(gzip.compress(part) for part in plain)
    stream, most, got = warc.Inflated(io.BytesIO(packed)), 0, hashlib.sha256()
    while stream.more():
        most = max(most, len(stream.held))
        got.update(stream.take(len(stream.held)))
    assert most <= warc.STEP and got.digest() == hashlib.sha256(b"".join(plain)).digest()
    stream = warc.Inflated(io.BytesIO(packed))
    assert stream.take(50_000_000) == plain[0] and stream.line() == b"one\n" and stream.line() == b"two\n"
    with pytest.raises(EOFError):
        cut = warc.Inflated(io.BytesIO(packed[:30_000]))
        cut.take(60_000_000)


def test_archives(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b\r\nX: y", None), (4, "", ""), (5, "u", "ü" * 300_000),
            (1, "again", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "alone"), (9, "crlf", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string").repartition(2)
    folder = new_folder(spark, "warc")
    files = warc.write_monolithic(pages, f"{folder}/whole", file_bytes=1000)
    index = warc.normalise(files, f"{folder}/members")
    got = warc.read_pages(index).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        to = to if to is not None and to != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for r in index.collect():
        store, path = filesystem(r["file"])
        with store.open_input_file(path) as source:
            source.seek(r["offset"])
            assert gzip.decompress(source.read(r["size"])).startswith(b"WARC/1.1\r\n")
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archived_pages(spark, pages.where("page_id < 4"), min_bytes=9).collect()} == {"response"}


def plain_repeats(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 5))
    return len(inside)


@pytest.mark.parametrize("text", ["", "a", "a b c d e", "a b c d e f a b c d e", "x x x x x x x", "a b c d e a b c d f", "a b c"])
def test_repeated_words(text):
    words = quality_crf.split_words(text)
    assert quality_crf.repeated_words(words) == plain_repeats(words)


def test_base_counts_of_samples(sample_rows):
    for _, text in sample_rows[:60]:
        words = quality_crf.split_words(text)
        n, chars, symbols, dup, repeats = quality_crf.base_counts(text, words)
        lines = [x for x in text.split("\n") if x.split()]
        assert (n, chars, symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert dup == len(lines) - len(set(lines))
        assert repeats == plain_repeats(words)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    field = quality_crf.LineField(rng.normal(size=(quality_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7):
        rows = rng.normal(size=(n, quality_crf.N_FEATURES))
        emitted = rows @ field.weights

        def value(path):
            return field.first[path[0]] + sum(emitted[i, s] for i, s in enumerate(path)) + sum(
                field.steps[a, b] for a, b in itertools.pairwise(path))

        assert tuple(field.viterbi(rows)) == max(itertools.product((0, 1), repeat=n), key=value)


def hidden_sample(rng, documents):
    return [(rng.normal(size=(n, quality_crf.N_FEATURES)), rng.integers(1, 20, n), m) for n, m in documents]


def test_sums_over_hidden_lines_are_those_over_all_paths():
    rng = np.random.default_rng(6)
    documents = hidden_sample(rng, [(1, 0), (4, 1), (2, 1), (6, 0), (4, 0)])
    params = rng.normal(size=2 * quality_crf.N_FEATURES + 6)
    weights, steps, first = quality_crf.unpacked(params)
    held = quality_crf.Sample(documents, 4.0)
    expected = 0.0
    for rows, words, mark in documents:
        emitted = rows @ weights

        def value(path):
            return first[path[0]] + sum(emitted[i, s] for i, s in enumerate(path)) + sum(steps[a, b] for a, b in itertools.pairwise(path))

        paths = list(itertools.product((0, 1), repeat=len(rows)))
        free = sum(math.exp(value(p)) for p in paths)
        told = sum(math.exp(value(p) + 4.0 * sum(words[i] for i, s in enumerate(p) if s == mark) / words.sum()) for p in paths)
        alike = sum(m == mark for _, _, m in documents)
        expected += 0.5 / alike / len(rows) * (math.log(free) - math.log(told))
    assert held.loss(params, 0.0, 0.0)[0] == pytest.approx(expected, rel=1e-9)


def test_slope_of_the_field_by_finite_differences():
    rng = np.random.default_rng(7)
    held = quality_crf.Sample(hidden_sample(rng, [(3, 0), (5, 1), (1, 1), (9, 0)]), 4.0)
    params = rng.normal(size=2 * quality_crf.N_FEATURES + 6)
    slope = held.loss(params, 1e-3, 3e-2)[1]
    for i in range(len(params)):
        step = np.zeros_like(params)
        step[i] = 1e-5
        change = (held.loss(params + step, 1e-3, 3e-2)[0] - held.loss(params - step, 1e-3, 3e-2)[0]) / 2e-5
        assert slope[i] == pytest.approx(change, abs=1e-8)


def test_lines_differ_from_their_document(labelled):
    """Held-out documents hold lines of both states, and a planted one is decoded line by line."""
    documents, labels = labelled
    field = quality_crf.quality_model(documents, labels)
    held = documents.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0 and text is not null").collect()
    shares = [field.content_share(r["text"]) for r in held]
    assert sum(0 < x < 1 for x in shares) >= 2
    good = next(r["text"] for r in held if r["quality"] == 1 and r["lang"] == "en" and 3 <= len(r["text"].split("\n")) and len(r["text"]) > 600)
    lines = [x for x in good.split("\n") if x.strip()]
    junk = ["HOME | LOGIN | $$$ | 12345 | ###", "buy!! now!! buy!! now!! 99$ | 99$ | 99$", "HOME | LOGIN | $$$ | 12345 | ###"] * 4
    states = field.viterbi(quality_crf.lines_of("\n".join(lines + junk))[0])
    assert states[:len(lines)].mean() >= 0.8 and states[len(lines):].mean() <= 0.1
    assert 0 < field.content_share("\n".join(lines + junk)) < 1


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return table(spark, d, "documents"), table(spark, d, "labels")


def test_quality_on_labelled_documents(spark, labelled, docs_of, edge_rows):
    documents, labels = labelled
    judged = quality_crf.judged(documents, labels).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean(good) > 0.97
    assert np.mean([r["kept"] for r in judged if r["quality"] == 0]) < 0.1
    edges = quality_crf.judged(docs_of(edge_rows), labels).collect()
    assert len(edges) == len(edge_rows)
    assert all(r["base_failed"] and not r["kept"] for r in edges if r["n_words"] == 0)
    assert quality_crf.judged(docs_of([]), labels).count() == 0


def test_toxicity_on_held_out_documents(labelled, docs_of, edge_rows):
    documents, labels = labelled
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    bad, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([b > c for b in bad for c in clean]) > 0.8
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    edges = toxicity.toxicity(docs_of(edge_rows), labels).collect()
    assert len(edges) == len(edge_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in edges)
    assert toxicity.toxicity(docs_of([]), labels).count() == 0


def test_unseen_misspellings_share_subwords():
    rng = random.Random(5)
    plain = ["the", "river", "carries", "stones", "while", "people", "walk", "along", "green", "fields"]
    sample = [(" ".join(rng.choice(plain) for _ in range(40)), 0) for _ in range(80)]
    sample += [(" ".join(rng.choice(plain) for _ in range(20)) + f" {w} " + " ".join(rng.choice(plain) for _ in range(20)), 1)
               for w in ["stupid", "stupidly", "stupids", "stupider"] * 20]
    model = toxicity.fit(sample)
    assert model.score("the river stupidd walk") > 0.5 > model.score("the river walk along green stones")
    assert model.score("") < 0.5


def test_one_of_each_decides_by_row(spark, docs_of):
    a, b, c = "a b c d e f g", "quite other words stand here now", "nothing like the others at all"
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, a), (None, a), (None, None), (10, None), (11, "")]
    for parts in (1, 4):
        kept = simhash_dedup.one_of_each(docs_of(rows).repartition(parts)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(
            [(1, a), (5, b), (9, c), (10, None), (None, a), (None, None)], key=repr)
    empty = simhash_dedup.one_of_each(docs_of(rows).limit(0))
    assert empty.count() == 0 and empty.columns == docs_of(rows).columns


def test_sample_is_a_function_of_the_rows(spark):
    """Conflicting labels, several texts of a doc_id and the layout change nothing."""
    documents = [(i, f"text of document {i} " * (1 + i % 7)) for i in range(60)] + [(5, "another text of five"), (6, None), (7, ""), (5, "zzz")]
    labels = [(i, i % 2, 0) for i in range(60)] + [(5, 0, 0), (7, 1, 0), (8, 1, 0), (None, 1, 0), (9, None, 0), (90, 1, 0)]
    samples = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(parts)
        marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int").repartition(parts)
        samples.append(labelled_sample(docs, marks, "toxic", 10))
    assert samples[0] == samples[1] == samples[2] and [m for _, m in samples[0]] == [0] * 10 + [1] * 10
    whole = labelled_sample(docs, marks, "toxic", 1000)
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    learnt = {t: m for t, m in whole}
    for i in set(range(60)) - held - {5}:
        assert learnt[documents[i][1]] == (0 if i in (5, 8) else i % 2)
    assert len(whole) == 60 - len(held)
    if 5 not in held:
        assert sum(t in (documents[5][1], "another text of five", "zzz") for t in learnt) == 1


def test_sample_takes_long_documents_up_to_a_total(spark):
    documents = spark.createDataFrame([(i, "x" * (30_000 if i == 1 else 100)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert any(len(t) == 30_000 for t, _ in labelled_sample(documents, labels, "toxic", 100))
    small = labelled_sample(documents, labels, "toxic", 100, most_drawn=1000)
    assert len(small) == 10 and all(len(t) == 100 for t, _ in small)


def test_sample_leaves_the_held_out_fold(labelled):
    documents, labels = labelled
    held = {r["text"] for r in documents.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    free = {r["text"] for r in documents.where("crc32(cast(doc_id as string)) % 5 <> 0").collect()}
    drawn = {t for t, _ in labelled_sample(documents, labels, "toxic", 50)}
    assert drawn <= free and not (drawn - free) & held


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    tox, crf = toxicity.toxicity_model(docs, labels), None
    rows = [r for r in docs.collect() if tox.score(r["text"]) < 0.5]
    left = corpus_pipeline.drop_toxic(spark, docs, d)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in rows} and left.columns == docs.columns
    crf = quality_crf.quality_model(left, labels)
    rows = [r for r in rows if quality_crf.verdict(crf, r["text"])[6]]
    prints = [plain_fingerprint(r["text"]) for r in rows]
    names = [r["doc_id"] for r in rows]
    for _ in range(5):
        for a, b in itertools.combinations(range(len(rows)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                names[a] = names[b] = min(names[a], names[b])
    want = {r["doc_id"] for r, n in zip(rows, names, strict=True) if n == r["doc_id"]}
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == want
    # The packing columns are those of the packing operator over just the documents that stay.
    kept = docs.where(F.col("doc_id").isin(sorted(want)))
    alone = packing.pack_documents(kept).collect()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[c] for c in key) for r in out) == sorted(tuple(r[c] for c in key) for r in alone)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) == len({r["sequence_id"] for r in alone})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]


def test_pipeline_stages_at_the_edges(spark, docs_of, edge_rows):
    """Odd rows, clashing columns and an empty table go through every stage."""
    d = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (edge_rows, []):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == columns, name
            # What a stage lets through, it lets through as it was.
            assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= set(rows), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    # NULL, empty and wordless texts have too few words to be kept; of two equal rows one is.
    good = "The quick words of this line are all of them quite plain and short, and they go on.\n"
    stay = corpus_pipeline.drop_near_copies(spark, docs_of([(1, good), (1, good), (2, good), (3, None), (4, "")]), d)
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 3]
