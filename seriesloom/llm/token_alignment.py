"""Alignment of two tokenisers by lockstep merging over the token ends of many documents.

Both tokenisations of a document cover the same bytes, so their token ends are two sorted
lists. One numpy state vector holds, for every document of a slice, the place in both lists.
In each step every document moves the list whose next end is smaller, or both where the ends
are equal: there a group of tokens of A and B is cut off, and its links (all pairs of the
group) are emitted. Finished documents are compacted away. A long document enters as several
lanes, which begin where both tokenisers end a token, so the number of steps is bounded.

How many documents hold a linked pair of ids is counted over the whole corpus. A slice of
documents states its distinct pairs once, with the number of its documents that hold them;
these rows, not those of the documents, are summed and meet the sums again. A pair is at most
once in a slice, so no pair is a hot key.

Memory is bounded by a slice: a worker makes token lists, links and group texts for a part of
its slice at a time, and the pairs of the documents travel packed and meet the sums of their
slice in a group of their own, so that no batch holds many slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import byte_tokens
from seriesloom.llm.common import written
from seriesloom.llm.slices import bounded

#: Bytes of text in a slice (a longer text is a slice of its own).
SLICE = 2 << 20
#: Tokens of A in a lane, and token ends tried for its end.
LANE, TRIED = 512, 32
#: Bytes of text that are tokenised at once, links that are unfolded and tokens that are written.
TOKENISED, UNFOLD, WRITTEN = 1 << 18, 1 << 18, 1 << 17


class Pair:
    """The two tokenisers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = byte_tokens.encoder(path_a).encode_ordinary
        self.bytes_a = byte_tokens.vocabulary(path_a)
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = lambda texts: b.encode(texts, num_threads=1)
        self.bytes_b = tuple(
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(b.get_piece_size())
        )
        self.sizes_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.sizes_b = np.array(list(map(len, self.bytes_b)), np.int64)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; none for empty texts and where the bytes of the tokens differ from
        those of the text behind a space."""
        all_a, all_b = [], []
        of_b = self.encode_b([t or "" for t in texts])
        for text, b in zip(texts, of_b, strict=True):
            a: list[int] = []
            if text:
                want = (" " + text).encode()
                a = self.encode_a(" " + text)
                if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
                    a = []
            all_a.append(a)
            all_b.append(b if a else [])
        return all_a, all_b

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A end to end and where each text begins, and those of B. Lists of numbers
        take many times the room, so they are made for some of the texts at a time."""
        ends = np.cumsum([len((t or "").encode()) for t in texts])
        of_a, of_b, at = [_flat([])], [_flat([])], 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, done + TOKENISED, side="right")), at + 1)
            for found, lists in zip((of_a, of_b), self.tokens(texts[at:to]), strict=True):
                found.append(_flat(lists))
            at = to
        return *_joined(of_a), *_joined(of_b)


@cache
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each list has."""
    sizes = np.array(list(map(len, lists)), np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all parts, and where each list begins."""
    sizes = np.concatenate([n for _, n in parts])
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def lanes(ends_a: np.ndarray, at_a: np.ndarray, ends_b: np.ndarray, at_b: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Rows (first and last token of A, first and last of B): documents, long ones in parts.

    After every `lane` tokens of A the next ends are looked up among the ends of B; the
    first that B has too ends the lane. Where none of those tried does, the lane goes on.
    """
    from_a, to_a, from_b, to_b = at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]
    filled = to_a > from_a
    out = [np.stack([from_a, to_a, from_b, to_b], axis=1)[filled & (to_a - from_a <= 2 * lane)]]
    for a0, a1, b0, b1 in np.stack([from_a, to_a, from_b, to_b], axis=1)[filled & (to_a - from_a > 2 * lane)]:
        own_b = ends_b[b0:b1]
        tried = a0 + np.arange(lane, a1 - a0 - lane, lane)[:, None] + np.arange(min(TRIED, lane))
        place = np.searchsorted(own_b, ends_a[tried])
        both = own_b[np.minimum(place, len(own_b) - 1)] == ends_a[tried]
        hit = both.any(axis=1)
        first = both.argmax(axis=1)[hit]
        cut_a = tried[hit, first] + 1
        cut_b = b0 + place[hit, first] + 1
        out.append(
            np.stack([np.append(a0, cut_a), np.append(cut_a, a1), np.append(b0, cut_b), np.append(cut_b, b1)], axis=1)
        )
    return np.concatenate(out)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Groups (first and last token of A, first and last of B) of all lanes, in their order."""
    a, stop, b = lane[:, 0].copy(), lane[:, 1], lane[:, 2].copy()
    begin_a, begin_b = a.copy(), b.copy()
    groups = []
    while len(a):
        here, there = ends_a[a], ends_b[b]
        a += here <= there
        b += there <= here
        cut = np.flatnonzero(here == there)
        if len(cut):
            groups.append(np.stack([begin_a[cut], a[cut], begin_b[cut], b[cut]]))
            begin_a[cut], begin_b[cut] = a[cut], b[cut]
            going = a < stop
            if not going.all():
                a, stop, b, begin_a, begin_b = (x[going] for x in (a, stop, b, begin_a, begin_b))
    if not groups:
        return np.zeros((0, 4), np.int64)
    found = np.concatenate(groups, axis=1)
    groups.clear()
    return found[:, np.argsort(found[0])].T


def unfolded(groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token of A, pair of ids) of all links, a bounded number at a time.

    A pair of ids is one number, A's id in the upper half.
    """
    wide = groups[:, 3] - groups[:, 2]
    # One entry for each token of A: it has a link to every token of B in its group.
    per_a = np.repeat(wide, groups[:, 1] - groups[:, 0])
    first_b = np.repeat(groups[:, 2], groups[:, 1] - groups[:, 0])
    first_a = int(groups[0, 0]) if len(groups) else 0
    ends = np.cumsum(per_a)
    at = 0
    while at < len(per_a):
        done = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, done + UNFOLD, side="right")), at + 1)
        n = per_a[at:to]
        token = np.repeat(np.arange(at, to), n)
        inner = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        yield first_a + token, a[first_a + token].astype(np.int64) << 32 | b[first_b[token] + inner]
        at = to


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n end to end, and where each begins."""
    text = [str(i).encode() for i in range(n)]
    return np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, text)))])


def _written(groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups that follow each other as text, `a1,a2|b1;a3|b2,b3;`, and the end of each token in it."""
    a, b = a[groups[0, 0] : groups[-1, 1]], b[groups[0, 2] : groups[-1, 3]]
    groups = groups - np.repeat(groups[0, ::2], 2)
    n = len(a) + len(b)
    # Tokens in the order of the text: those of A in a group, then those of B.
    place_a = np.arange(len(a)) + np.repeat(groups[:, 2], groups[:, 1] - groups[:, 0])
    place_b = np.arange(len(b)) + np.repeat(groups[:, 1], groups[:, 3] - groups[:, 2])
    token, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    token[place_a], token[place_b] = a, b
    mark[place_a[groups[:, 1] - 1]] = ord("|")
    mark[place_b[groups[:, 3] - 1]] = ord(";")
    digits, where = _digits(max(int(token.max()) + 1, 1 << 16))
    size = where[token + 1] - where[token] + 1
    ends = np.cumsum(size)
    source = np.repeat(where[token] - (ends - size), size)
    source += np.arange(len(source))
    source[ends - 1] = 0
    out = digits[source]
    out[ends - 1] = mark
    return out.tobytes(), ends


def written_groups(groups: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[bytes]:
    """The groups of every document as text: `a1,a2|b1;a3|b2,b3`."""
    # Tokens of both before each document, and up to the end of each group.
    first, upto = at_a + at_b, groups[:, 1] + groups[:, 3]
    last = np.zeros(len(first), np.int64)
    parts, size, done, at = [], 0, 0, 0
    while at < len(groups):
        to = max(int(np.searchsorted(upto, done + WRITTEN, side="right")), at + 1)
        text, ends = _written(groups[at:to], a, b)
        here = (first > done) & (first <= upto[to - 1])
        last[here] = size + ends[first[here] - done - 1]
        parts.append(text)
        size, done, at = size + len(text), int(upto[to - 1]), to
    body = b"".join(parts)
    return [body[x : max(y - 1, x)] for x, y in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]


class Aligned:
    """The alignment of a slice of texts."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.a, self.at_a, self.b, self.at_b = pair.flat(texts)
        ends_a, ends_b = np.cumsum(pair.sizes_a[self.a]), np.cumsum(pair.sizes_b[self.b])
        self.groups = lockstep(ends_a, ends_b, lanes(ends_a, self.at_a, ends_b, self.at_b))
        #: First group of each document, and the end of the last.
        self.at_group = np.searchsorted(self.groups[:, 0], self.at_a)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over the groups of each document."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.at_group[1:]] - total[self.at_group[:-1]]

    def links(self) -> np.ndarray:
        wide = self.groups[:, 1] - self.groups[:, 0]
        return self.per_document(wide * (self.groups[:, 3] - self.groups[:, 2]))

    def texts(self) -> list[bytes]:
        return written_groups(self.groups, self.a, self.b, self.at_a, self.at_b)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids; and the document, the pair's number and the links of every
        distinct pair of a document."""
        owner = np.repeat(np.arange(len(self.at_a) - 1), np.diff(self.at_a))
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known: np.ndarray = np.zeros(0, np.int64)
        for token, ids in unfolded(self.groups, self.a, self.b):
            code, names = pd.factorize(np.concatenate([known, ids]))
            known = names
            key, n = np.unique(owner[token] << 32 | code[len(code) - len(ids) :], return_counts=True)
            keys.append(key)
            sums.append(n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)
        return known, key >> 32, key & 0xFFFFFFFF, n


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, the ids `a` and `b`, the cuts `a_cuts` and `b_cuts` (how many tokens lie before
    the end of each group) and `groups` as text, for every document.

    Texts null or empty, and texts whose tokens do not spell a space and the text, have no
    tokens and no groups. Keys are carried whatever their type, null ones too; repeated rows
    give a row each; other columns are left out; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def listed(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        for batch in batches:
            for part in bounded(batch, 1, SLICE):
                found = Aligned(pair, part.column(1).to_pylist())
                doc = np.searchsorted(found.at_a, found.groups[:, 0], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        listed(found.at_a, found.a),
                        listed(found.at_b, found.b),
                        listed(found.at_group, found.groups[:, 1] - found.at_a[doc]),
                        listed(found.at_group, found.groups[:, 3] - found.at_b[doc]),
                        pa.array(found.texts(), pa.binary()).cast(pa.string()),
                    ],
                    names=[key, "a", "b", "a_cuts", "b_cuts", "groups"],
                )

    schema = f"`{key}` {kind}, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>, groups string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest of them needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else np.uint8)


def _slices(docs: DataFrame, path_a: str, path_b: str, text: str, key: str) -> DataFrame:
    """One row for each slice of documents: what its documents have, its distinct pairs with
    the number of documents that hold them, and the distinct pairs of every document."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"slice long, docs array<struct<`{key}`: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, "
        "groups_sha256: string, n_held: int>>, pairs array<long>, holders array<int>, held binary, times binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = load(path_a, path_b), 0
        for batch in batches:
            for part in bounded(batch, 1, SLICE):
                found = Aligned(pair, part.column(1).to_pylist())
                pairs, owner, held, times = found.held()
                n_docs = part.num_rows
                digest = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts()]
                columns = [
                    part.column(0),
                    *(
                        pa.array(x, pa.int64())
                        for x in (np.diff(found.at_a), np.diff(found.at_b), np.diff(found.at_group), found.links())
                    ),
                    pa.array(digest, pa.string()),
                    pa.array(np.bincount(owner, minlength=n_docs), pa.int32()),
                ]
                names = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_held"]

                def single(values: pa.Array) -> pa.ListArray:
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                        single(pa.StructArray.from_arrays(columns, names=names)),
                        single(pa.array(pairs, pa.int64())),
                        single(pa.array(np.bincount(held, minlength=len(pairs)), pa.int32())),
                        pa.array([packed(held)], pa.binary()),
                        pa.array([packed(times)], pa.binary()),
                    ],
                    names=["slice", "docs", "pairs", "holders", "held", "times"],
                )
                number += 1

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pair_counts(slices: DataFrame) -> DataFrame:
    """`pair`, `n` (documents that hold it linked) and `best` (the highest n of its A id)."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    # At most one row for each id of A's vocabulary.
    top = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("_a")).select(
        "pair", "n", (F.col("n") == F.col("_top")).alias("best")
    )


def linked(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups_sha256 (of the groups as text; empty
    without tokens), and over its links `n_best`, those whose pair of ids is held by as many
    documents as any pair of its A id, and `count_sum`, the sum of the pairs' documents.

    Rows count as documents: repeated rows each hold their pairs. Null keys are carried. The
    cases of `align` hold here too; such documents have zeros.
    """
    kind = docs.schema[key].dataType.simpleString()
    slices = written(_slices(docs, path_a, path_b, text, key), "align-slices")
    counts = written(pair_counts(slices), "align-pairs")
    posted = slices.select("slice", F.posexplode("pairs").alias("at", "pair"))
    told = posted.join(counts, "pair").select(F.col("slice").alias("_slice"), "at", "n", "best")

    def run(whole: pa.Table, told: pa.Table) -> pa.Table:
        """The documents of one slice, with the sums of its pairs."""
        documents = whole.column("docs")[0].values
        n_held = documents.field(6).to_numpy()
        n, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, bool)
        place = told.column("at").to_numpy()
        n[place], best[place] = told.column("n").to_numpy(), told.column("best").to_numpy()
        held, times = (unpacked(whole.column(c)[0].as_py(), int(n_held.sum())) for c in ("held", "times"))
        total = np.concatenate([[0], np.cumsum(times * n[held])])
        good = np.concatenate([[0], np.cumsum(times * best[held], dtype=np.int64)])
        at = np.concatenate([[0], np.cumsum(n_held)])
        return pa.Table.from_arrays(
            [
                *(documents.field(k) for k in range(5)),
                pa.array(good[at[1:]] - good[at[:-1]], pa.int64()),
                pa.array(total[at[1:]] - total[at[:-1]], pa.int64()),
                documents.field(5),
            ],
            names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    schema = (
        f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string"
    )
    whole = slices.select("slice", "docs", "held", "times")
    return whole.groupBy("slice").cogroup(told.groupBy("_slice")).applyInArrow(run, schema)
