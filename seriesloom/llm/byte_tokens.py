"""Byte-level BPE ids of whole texts, from a vocabulary in the tokenizers library's JSON form."""

from __future__ import annotations

import json
from functools import cache

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for the letters from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def vocabulary(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level vocabulary, without its special tokens."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    out = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        out[i] = bytes(letters[c] for c in token)
    return tuple(out)


@cache
def encoder(path: str):
    """An encoder whose `encode_ordinary(text)` gives the ids; special strings are plain text."""
    import tiktoken

    ranks = {token: i for i, token in enumerate(vocabulary(path)) if token}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
