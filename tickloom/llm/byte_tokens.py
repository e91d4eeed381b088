"""Byte-level BPE ids of whole texts as arrays, without Python lists.

The tokenizer file gives the vocabulary; tiktoken merges by the same ranks and hands out arrays,
which is several times faster than the file's own library. Tests compare the two.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

FILE = "byte_bpe_50k.json"
#: White space of the file's pattern (Unicode White_Space, unlike Python's own class) in runs far below the
#: million characters at which tiktoken's regex gives up.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
RUN_CHARS = 100_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: bytes that print stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        stand_in = _byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = tuple(special)
        ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding(
            "byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.n_ids = 1 + max(max(ranks.values()), *special.values())
        #: UTF-8 bytes of each id.
        self.widths = np.zeros(self.n_ids, np.int64)
        self.widths[list(ranks.values())] = [len(token) for token in ranks]
        for mark, i in special.items():
            self.widths[i] = len(mark.encode())

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids; the strings of special tokens become those tokens."""
        try:
            return self.coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the regex gave up on a long run of white space
            return np.concatenate(list(self._around_runs(text)))

    def _around_runs(self, text: str):
        """The ids of a text cut at its long runs of white space, where the pattern itself cuts.

        `\\s+(?!\\S)` takes a whole run at the end of the text or before a special token; elsewhere it
        leaves the run's last character to the word behind it.
        """
        at = 0
        for run in LONG_RUN.finditer(text):
            start, end = run.span()
            if end - start < RUN_CHARS:
                continue
            if end < len(text) and not text.startswith(self.special, end):
                end -= 1
            yield self.coder.encode_to_numpy(text[at:start], allowed_special="all")
            yield np.array(self.coder._encode_single_piece(text[start:end]), np.uint32)
            at = end
        yield self.coder.encode_to_numpy(text[at:], allowed_special="all")


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One per worker."""
    return ByteTokens(path)
