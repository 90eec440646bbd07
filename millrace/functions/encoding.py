"""Tokens of a public byte-level vocabulary, for sizes and windows of texts."""

from __future__ import annotations

import base64
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
"""Where the vocabulary lies on every worker; a parameter wherever tokens are used."""


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY):
    """The encoder of a vocabulary file, read once per worker."""
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_windows(text: str, size: int, overlap: int, path: str = VOCABULARY) -> list[tuple[str, int]]:
    """A text in windows of at most ``size`` tokens that overlap, with their tokens counted; a character cut by a border is left out there."""
    enc = vocabulary(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= size:
        return [(text, len(ids))] if ids else []
    starts = range(0, len(ids) - overlap, size - overlap)
    return [(enc.decode_bytes(ids[s : s + size]).decode("utf-8", "ignore"), len(ids[s : s + size])) for s in starts]
