"""Operator 8: token counts by section, from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.byte_tokens import FILE, byte_tokens
from tickloom.llm.common import batched, rows_of, text_or_empty

SECTIONS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                      ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
RULES = ("first", "last", "most")


def line_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which the sections of a text begin: its lines, each with its line end."""
    return np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1)


def attributed(token_ends: np.ndarray, section_starts: np.ndarray, n_bytes: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens among them that reach over a boundary).

    Tokens and sections are intervals that each cover the bytes 0 .. n_bytes without gaps, so the
    interval join is a binary search of token bounds among section bounds.
    """
    token_starts = np.append(0, token_ends[:-1]) if len(token_ends) else token_ends
    low = np.searchsorted(section_starts, token_starts, "right") - 1
    high = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    owner = (low if rule == "first" else high).copy()
    crossing = np.flatnonzero(high > low)
    if rule == "most":
        section_ends = np.append(section_starts[1:], n_bytes)
        for i in crossing:
            touched = np.arange(low[i], high[i] + 1)
            shares = np.minimum(section_ends[touched], token_ends[i]) - np.maximum(section_starts[touched], token_starts[i])
            owner[i] = touched[np.argmax(shares)]
    n = len(section_starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(documents: DataFrame, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: one row per line of every document.

    The whole text is encoded once. Ids carry their width in bytes, which gives each token its span;
    spans meet the sections (lines split at \\n, the line end belongs to its line; `start` and `end`
    are UTF-8 byte offsets). A token that crosses a boundary goes whole to one section by `rule`:
    `first` or `last` section it touches, or the one with `most` of its bytes (ties: the first). So
    the counts of a document add up to its number of ids. A NULL or empty text has one empty section
    with 0 tokens; a text that ends in \\n has an empty last section. NULL doc_ids and repeated rows
    are kept row by row. Nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokenizer = tokenizer or public_tokenizers.path(FILE)

    def counted(batches):
        coder = byte_tokens(tokenizer)

        def made():
            for doc_id, text in rows_of(batches):
                data = text.encode()
                starts = line_starts(data)
                counts, crossing = attributed(np.cumsum(coder.widths[coder.encode(text)]), starts, len(data), rule)
                yield from zip([doc_id] * len(starts), range(len(starts)), starts.tolist(),
                               [*starts[1:].tolist(), len(data)], counts.tolist(), crossing.tolist(), strict=True)

        yield from batched(made(), SECTIONS)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        counted, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")
