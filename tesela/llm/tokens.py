"""A public byte-level tokenizer on the workers; its vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os

import numpy as np

# Fixed value: the published splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Vocabulary in tiktoken's format; TESELA_VOCABULARY overrides it.
VOCABULARY = os.environ.get("TESELA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

_loaded: dict[str, tuple] = {}


def encoder(path: str):
    """``(encoding, lengths)``: the encoding of a vocabulary file and the bytes of each of its tokens; kept per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]
