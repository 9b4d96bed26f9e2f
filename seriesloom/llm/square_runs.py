"""Periodic runs of words, caught online over dyadic blocks.

A run is a maximal stretch of words with a smallest period q and at least 2 q words. Words
are appended from left to right. Whenever a block of b = 2, 4, 8, ... words is completed, a
catcher is set on it; it lies in wait for repeats of its block at a distance from 2 b to
4 b. Each appended word completes one suffix of b words, and the two catchers of every size
whose distance fits are compared with that suffix (hashes of b words, from prefix sums). A
hit is a repeat of a whole block at some distance p: it is extended to both sides, and if the
two copies touch, a square is reported. The first copy of a square of period p in [2 b, 4 b)
holds a whole aligned block of b words, so no square escapes the catchers of its size.
Squares of the same period that overlap are one run. Shorter periods are compared word by
word. The work is n log n for n words and the memory grows with n, however periodic the text.

The comparisons of one size at all appended words of many texts are one numpy comparison.
Hashes only propose: every run is confirmed on the words, and equal hashes of different words
fall back to comparing words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.slices import bounded

LEAST = 12
#: Bytes of text whose words are worked at once (a longer text is worked alone).
SLICE = 4 << 20
#: The smallest block with catchers; periods below twice its size are compared word by word.
BLOCK = 4

_RNG = np.random.default_rng(11)
_FACTOR = int(_RNG.integers(1, 2**62)) * 2 + 1


class Words:
    """The words of some texts as numbers, with hashes of all their substrings."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        n = len(ids)
        self.ids = ids
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.low, self.high = at[:-1][self.text], at[1:][self.text]
        step = np.full(n + 1, _FACTOR, np.uint64)
        back = np.full(n + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        power = np.cumprod(step)
        self.back = np.cumprod(back)
        values = np.random.default_rng(5).integers(1, 2**63, int(ids.max(initial=0)) + 1, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[ids] * power[:n], dtype=np.uint64)])

    def hashed(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree from x and from y on (x < y, same text)."""
        room = self.high[x] - y
        got = np.zeros_like(x)
        size = 1 << max(int(room.max(initial=0)), 1).bit_length() - 1
        while size:
            fits = got + size <= room
            a, b = x[fits] + got[fits], y[fits] + got[fits]
            got[fits] += size * (self.hashed(a, size) == self.hashed(b, size))
            size >>= 1
        return got

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree just before x and before y."""
        room = x - self.low[x]
        got = np.zeros_like(x)
        size = 1 << max(int(room.max(initial=0)), 1).bit_length() - 1
        while size:
            fits = got + size <= room
            a, b = x[fits] - got[fits] - size, y[fits] - got[fits] - size
            got[fits] += size * (self.hashed(a, size) == self.hashed(b, size))
            size >>= 1
        return got


def _short(words: Words, period: int) -> np.ndarray:
    """Runs (start, end, period) of a short period, compared word by word."""
    ids = words.ids
    if len(ids) <= period:
        return np.zeros((0, 3), np.int64)
    equal = np.zeros(len(ids) + 1, np.int8)
    equal[period:-1] = (ids[period:] == ids[:-period]) & (words.text[period:] == words.text[:-period])
    turn = np.diff(equal, prepend=0)
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = last - first >= period
    return np.stack([first[long] - period, last[long], np.full(long.sum(), period)], axis=1)


def _caught(words: Words, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, suffix start) of all hits of the catchers of one size."""
    place = np.flatnonzero(words.high - words.low >= 4 * block)
    local = place - words.low[place]
    fits = (local >= 2 * block) & (place + block <= words.high[place])
    place, local = place[fits], local[fits]
    suffix = words.hashed(place, block)
    starts, ends = [], []
    for blocks_back in (2, 3):
        caught = (local // block - blocks_back) * block
        ready = caught >= 0
        start = words.low[place[ready]] + caught[ready]
        hit = words.hashed(start, block) == suffix[ready]
        starts.append(start[hit])
        ends.append(place[ready][hit])
    return np.concatenate(starts), np.concatenate(ends)


def _inside(start: np.ndarray, end: np.ndarray, period: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether [start, end) lies in a known run whose period divides the given one: such a
    hit repeats that run and brings nothing new."""
    if not len(runs):
        return np.zeros(len(start), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    best = np.maximum.accumulate(runs[:, 1])
    owner = np.maximum.accumulate(np.where(runs[:, 1] == best, np.arange(len(runs)), 0))
    at = np.searchsorted(runs[:, 0], start, side="right") - 1
    found = runs[owner[np.maximum(at, 0)]]
    return (at >= 0) & (found[:, 1] >= end) & (period % found[:, 2] == 0)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of several periods of one stretch only the smallest, which is the period of the run."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = np.zeros(len(runs), bool)
    again[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    return runs[~again]


def _confirmed(words: Words, runs: np.ndarray) -> np.ndarray:
    """The runs, cut down to what the words themselves bear out."""
    ids, out = words.ids, []
    for start, end, period in runs.tolist():
        same = ids[start : end - period] == ids[start + period : end]
        if same.all():
            out.append((start, end, period))
            continue
        edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        out += [(start + a, start + b + period, period) for a, b in edges.tolist() if b - a >= period]
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` words, by start and period.

    `ids` are the word numbers of texts laid end to end, text k from at[k] to at[k + 1].
    """
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    words = Words(ids, at)
    found = [_short(words, p) for p in range(1, 2 * BLOCK)]
    block, longest = BLOCK, int(np.diff(at).max())
    while 4 * block <= longest:
        found = [_smallest(np.concatenate(found))]
        known = found[0][found[0][:, 1] - found[0][:, 0] >= 3 * block]
        start, suffix = _caught(words, block)
        new = ~_inside(start, suffix + block, suffix - start, known)
        start, suffix = start[new], suffix[new]
        if len(start):
            period = suffix - start
            first = start - words.before(start, suffix)
            last = suffix + words.after(start, suffix)
            square = last - first >= 2 * period
            merged = np.unique(np.stack([first[square], last[square], period[square]], axis=1), axis=0)
            found.append(_confirmed(words, merged))
        block *= 2
    runs = _smallest(np.concatenate(found))
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """`key`, `n_words`, `runs` (by start, then period) and `collapsed`, the text without
    repetitions: the words no run holds behind its first period, joined by single spaces.

    Words are maximal stretches without ASCII white space. Null and blank texts have no
    words, no runs and an empty collapsed text. Keys are carried whatever their type, null
    ones too; repeated rows give a row each; other columns are left out; an empty table
    gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1, SLICE):
                yield _worked(part, key, least)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {RUNS}")


def _worked(part: pa.RecordBatch, key: str, least: int) -> pa.RecordBatch:
    texts = [t.split() for t in part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(at[-1]))
    runs = find_runs(ids, at, least)
    keep = kept_words(len(ids), runs)
    whole = np.logical_and.reduceat(np.append(keep, True), at[:-1]) if len(texts) else np.zeros(0, bool)
    collapsed = [
        b" ".join(t if all_kept else compress(t, keep[a:b].tolist()))
        for t, a, b, all_kept in zip(texts, at[:-1].tolist(), at[1:].tolist(), whole.tolist(), strict=True)
    ]
    owner = np.searchsorted(at, runs[:, 0], side="right") - 1
    columns = [runs[:, 0] - at[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
    edges = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(np.diff(at), pa.int64()),
            pa.ListArray.from_arrays(edges, items),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        names=[key, "n_words", "runs", "collapsed"],
    )


def run_lines(runs: Column) -> Column:
    """The runs as text, one line `start,length,period` each."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of several the one that starts first, with the least period."""
    order = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))
    )
    return F.array_min(order)
