"""Encoders, token shards, packing and token counts against the file's own library and plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import byte_tokens, packing, token_counts, token_shards, word_bpe
from tickloom.llm.common import new_folder


@pytest.fixture(scope="module")
def byte_file():
    return Tokenizer.from_file(public_tokenizers.path(byte_tokens.FILE))


@pytest.fixture(scope="module")
def word_file():
    return Tokenizer.from_file(public_tokenizers.path(word_bpe.FILE))


def byte_ids(file, text):
    return file.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_ids_equal_the_files_library(byte_file, edge_rows, sample_rows):
    coder = byte_tokens.byte_tokens(public_tokenizers.path(byte_tokens.FILE))
    for _, text in edge_rows + sample_rows:
        assert coder.encode(text or "").tolist() == byte_ids(byte_file, text)


@pytest.mark.parametrize("text", ["a" + " " * 1_000_100 + "b c", "\n" * 1_200_000, "x  " + " \t" * 600_000 + "<|endoftext|>  y",
                                  " " * 1_000_100 + "\n'll", "\u3000\xa0" * 550_000 + "\x1c1", "é" + "\n" * 1_100_000 + "z" + " " * 1_100_000])
def test_byte_ids_of_long_white_space(byte_file, text):
    coder = byte_tokens.byte_tokens(public_tokenizers.path(byte_tokens.FILE))
    assert coder.encode(text).tolist() == byte_ids(byte_file, text)


def test_long_white_space_is_packed(docs_of, byte_file):
    rows = [(1, "a" + " " * 1_000_100 + "b"), (2, "c d")]
    got = packing.pack_documents(docs_of(rows)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {i: len(byte_ids(byte_file, t)) + 1 for i, t in rows}


def test_word_bpe_equals_the_files_library(docs_of, word_file, edge_rows, sample_rows):
    odd = [(100 + i, t) for i, t in enumerate(["x\x1cy \x1d z", "á é", "'S 'LL don'T", "thea" * 60 + "ing", "word.\x85next",
                                               "<|startoftext|>A<|endoftext|>", "a b　c", "xyz" * 3000])]
    rows = edge_rows + odd + [(1000 + i, t) for i, t in sample_rows]
    got = sorted(map(tuple, word_bpe.coded_documents(docs_of(rows)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = word_file.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(word_file.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_word_bpe_small_tables_of_known_chunks(word_file, sample_rows):
    coder = word_bpe.WordBpe(public_tokenizers.path(word_bpe.FILE), limit=50)
    for _, text in sample_rows[:20]:
        (n, ids, decoded), = coder.encode_batch([text])
        want = word_file.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == coder.decode(want) == word_file.decode(want, skip_special_tokens=False)


def test_word_merges_long_and_short_agree():
    coder = word_bpe.word_bpe(public_tokenizers.path(word_bpe.FILE))
    words = [coder.symbols(w + coder.end) for w in ("theringstion", "aaaaaaaaaaa", "xyzzy", "mississippi")]
    assert coder.merged(words) == [coder.merged_long(w) for w in words]


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {1: 5000}, {700: 10, 324: 7, 100: 40, 24: 9}, {600: 11}, {341: 9, 342: 3, 683: 2}])
def test_plan_uses_every_piece_once(counts):
    plan = packing.packing_plan(counts, 1024)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


def test_plan_fills_exactly():
    assert packing.packing_plan({600: 1, 424: 1, 500: 1, 300: 1, 224: 1}, 1024) == [(1, (600, 424)), (1, (500, 300, 224))]


def test_packing(docs_of, byte_file, edge_rows, sample_rows):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_rows]
    got = packing.pack_documents(docs_of(rows)).collect()
    want = []
    for doc_id, text in rows:
        ids, start = byte_ids(byte_file, text) + [2], 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.append((doc_id, piece, start, n, crc(ids[start:start + n])))
            start += n
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= math.ceil(total / 1024) * 1.05 + 1


def test_training_order_round_trip(spark, docs_of, byte_file, edge_rows, sample_rows):
    rows = edge_rows + [(1000 + i, t) for i, t in sample_rows]
    path = new_folder(spark, "documents")
    docs_of(rows).write.parquet(path)
    folder = new_folder(spark, "shards")
    index = token_shards.write_training_order(spark.read.parquet(path), folder, shard_bytes=200_000)
    got = token_shards.read_training_order(index, folder).collect()
    want = []
    for doc_id, text in rows:
        ids = byte_ids(byte_file, text) + [50256]
        want += [(doc_id, i // 512, i, len(ids[i:i + 512]), crc(ids[i:i + 512])) for i in range(0, len(ids), 512)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r["slot"] for r in got) == list(range(len(want)))
    assert index.count() > 1
    by_slot = {r["slot"]: r for r in got}
    late = token_shards.read_training_order(index, folder, from_slot=len(want) // 2).collect()
    assert sorted(r["slot"] for r in late) == list(range(len(want) // 2, len(want)))
    assert all(r == by_slot[r["slot"]] for r in late)


def test_token_counts(docs_of, byte_file, edge_rows):
    rows = edge_rows + [(20, "a\n\n\nb c\n"), (21, "x \n  \n y")]
    got = token_counts.count_tokens(docs_of(rows), "first").collect()
    want = []
    for doc_id, text in rows:
        text = text or ""
        code = byte_file.encode(text, add_special_tokens=False)
        lines = text.split("\n")
        starts = [0]
        for line in lines[:-1]:
            starts.append(starts[-1] + len(line.encode()) + 1)
        n, at = [0] * len(lines), 0
        for piece in code.tokens:
            n[max(i for i, s in enumerate(starts) if s <= at)] += 1
            at += len(piece) if not piece.startswith("<|") else len(piece.encode())
        want += [(doc_id, i, starts[i], n[i]) for i in range(len(lines))]
    assert sorted(((r["doc_id"], r["section"], r["start"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)


def test_crossing_tokens_follow_the_rule():
    ends, starts = np.array([2, 5, 9]), np.array([0, 4, 5])
    assert token_counts.attributed(ends, starts, 9, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attributed(ends, starts, 9, "last")[0].tolist() == [1, 1, 1]
    assert token_counts.attributed(ends, starts, 9, "most")[0].tolist() == [2, 0, 1]
    assert token_counts.attributed(np.array([4]), np.array([0, 2]), 4, "most")[1].tolist() == [1, 0]


def test_empty_tables(docs_of, spark):
    none = docs_of([])
    assert packing.pack_documents(none).count() == 0
    assert word_bpe.coded_documents(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    path = new_folder(spark, "none")
    none.write.parquet(path)
    assert token_shards.training_order(spark, spark.read.parquet(path)).count() == 0
