"""Registered queries of the operators: name -> (Spark callable, DuckDB text or None).

Operators 11 and 12 have a DuckDB text. The others rest on XXH64, CRC-32, SHA-1 in base 32, tokenizers and
fitted models, which DuckDB lacks: tests/llm compares them with brute force, round trips and held-out labels.
"""

from __future__ import annotations

from tickloom.llm import (collocations, doc_fingerprints, language_id, lexical_search, packing, quality_crf, sharding,
                          simhash_dedup, token_counts, token_shards, toxicity, warc, word_bpe)
from tickloom.llm.common import table

SHARDS = 24

QUERIES = {
    "op1_sharding": (lambda spark, d: sharding.shard_documents(table(spark, d, "documents"), SHARDS), None),
    "op2_token_shards": (lambda spark, d: token_shards.training_order(spark, table(spark, d, "documents")), None),
    "op3_word_bpe": (lambda spark, d: word_bpe.coded_documents(table(spark, d, "documents")), None),
    "op4_toxicity": (lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")), None),
    "op5_warc": (lambda spark, d: warc.archived_pages(spark, table(spark, d, "pages")), None),
    "op6_simhash_dedup": (lambda spark, d: simhash_dedup.near_duplicates(table(spark, d, "documents")), None),
    "op7_packing": (lambda spark, d: packing.pack_documents(table(spark, d, "documents")), None),
    "op8_token_counts": (lambda spark, d: token_counts.count_tokens(table(spark, d, "documents")), None),
    "op9_fingerprints": (lambda spark, d: doc_fingerprints.fingerprint_documents(table(spark, d, "documents")), None),
    "op10_quality_crf": (lambda spark, d: quality_crf.judged(table(spark, d, "documents"), table(spark, d, "labels")), None),
    "op11_collocations": (lambda spark, d: collocations.collocations(table(spark, d, "documents")), collocations.ORACLE_SQL),
    "op12_lexical_search": (lambda spark, d: lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
                            lexical_search.ORACLE_SQL),
    "op13_language_id": (lambda spark, d: language_id.predicted(table(spark, d, "documents")), None),
}
