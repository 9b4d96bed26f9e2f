"""BPE with word ends by a contiguous rank array, and decoding.

A word is an array of parts between boundaries and, beside it, an array with the rank of
every pair of neighbouring parts. The smallest rank is looked for by a scan, its boundary is
deleted from both arrays, and the ranks to the left and right are looked up again; the scan
repeats until no pair has a rank. Words are short, so a scan beats any ordered structure;
words of more than LONG symbols, where scans would grow with the square of the length, take
the same merges from a heap.

Texts are cut at ASCII white space, and every distinct piece of a slice of texts is worked
once: no rule of the normaliser or of the splitting pattern reaches across such a cut.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.slices import bounded

#: Symbols up to which a word is merged by scanning.
LONG = 256
#: Bytes of text that are worked at once.
SLICE = 8 << 20
#: Letters and ids of words that are remembered from slice to slice of a task, in bytes.
REMEMBERED = 16 << 20

_NONE = 1 << 62

#: Fixed value: the splitting pattern, for lower-case ASCII without white space.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class RankBpe:
    """A vocabulary with merges, an end-of-word suffix and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        # Only the text normalisation and the splitting into words are the library's.
        self._normal = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.single = {t: i for t, i in vocab.items() if len(t.removesuffix(self.end) or t) == 1}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = {k.encode(): v for k, v in specials.items()}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self._special = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if specials else None
        names = vocab | specials
        self.names = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.names[i] = token.encode()

    def scan(self, parts: list[int]) -> list[int]:
        """Merge by the rank array."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            here = parts[at] = merged[low]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(here << 32 | parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | here, _NONE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: smallest rank first, leftmost of equal ones."""
        get, merged, n = self.ranks.get, self.merged, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            right = after[at]
            if parts[at] < 0 or right == n or get(parts[at] << 32 | parts[right], _NONE) != rank:
                continue
            parts[at], parts[right] = merged[rank], -1
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                if (r := get(parts[at] << 32 | parts[right], _NONE)) < _NONE:
                    heapq.heappush(queue, (r, at))
            left = before[at]
            if left >= 0 and (r := get(parts[left] << 32 | parts[at], _NONE)) < _NONE:
                heapq.heappush(queue, (r, left))
        return [p for p in parts if p >= 0]

    def word(self, letters: str) -> bytes:
        """Ids of one word of byte letters, as little-endian 32-bit numbers."""
        single = self.single
        parts = [single[c] for c in letters[:-1]]
        parts.append(single[letters[-1] + self.end])
        parts = self.scan(parts) if len(parts) <= LONG else self.heap(parts)
        return array("I", parts).tobytes()

    def words(self, raw: bytes) -> list[str]:
        """The words of a piece, in byte letters. Printable ASCII letters stand for themselves."""
        if raw.isascii() and (text := raw.decode()).isprintable():
            return _ASCII_WORDS.findall(text.lower())
        return [w for w, _ in self._split(self._normal(raw.decode())) if w]

    def piece(self, raw: bytes, words: dict[str, bytes]) -> bytes:
        """Ids of a piece of text without ASCII white space."""
        out: list[bytes] = []
        for part in self._special.split(raw) if self._special and b"|>" in raw else (raw,):
            special = self.specials.get(part)
            if special is not None:
                out.append(array("I", [special]).tobytes())
                continue
            for word in self.words(part) if part else ():
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = self.word(word)
                out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes], words: dict[str, bytes]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers; `words` remembers words."""
        cut = [t.split() for t in texts]
        known = {p: self.piece(p, words) for p in set(chain.from_iterable(cut))}
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """Names of the ids, joined by single spaces; unknown ids are left out."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(names) and names[i]])


@cache
def load(path: str) -> RankBpe:
    return RankBpe(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, `n_tokens`, `ids` (little-endian 32-bit numbers) and `decoded` of whole texts.

    Null and empty texts, and texts of white space alone, have no tokens and decode to the
    empty text. Keys are carried whatever their type, null ones too; repeated rows give a
    row each; other columns are left out; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load(path), {}
        for batch in batches:
            for part in bounded(batch, 1, SLICE):
                texts = part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                ids = bpe.encode(texts, known)
                if sum(map(len, known)) + sum(map(len, known.values())) > REMEMBERED:
                    known = {}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string()),
                    ],
                    names=[key, "n_tokens", "ids", "decoded"],
                )

    schema = f"`{key}` {kind}, n_tokens long, ids binary, decoded string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with `decoded` in place of the ids column; null ids decode to null."""
    rest = [f for f in encoded.schema.fields if f.name not in (ids, "decoded")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode() for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*(f.name for f in rest), "decoded"]
            )

    return encoded.select(*[F.col(f"`{f.name}`") for f in rest], F.col(ids)).mapInArrow(run, schema)
