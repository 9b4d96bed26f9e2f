"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once into pieces. Pieces of one length are interchangeable, so the
range-sorted pieces are runs of equal length, and open sequences are runs of equal gap. In
each superstep the longest remaining run sweeps its successor gaps (the smallest that hold
it): ranks inside the two runs say which piece takes which sequence, the gaps shrink, and
the next run follows; pieces without a gap open sequences. The sweep needs only the run
lengths, at most one per token length, whatever the corpus. The ranks themselves, counted
on salted parts of each length, and the placement are distributed.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import byte_tokens
from seriesloom.llm.common import written
from seriesloom.llm.slices import bounded

CAPACITY = 2048
END_ID = 0
#: Rows of one length that are ranked in one group.
RANKED = 4096
#: Bytes of text that are tokenised at once.
SLICE = 8 << 20


class TextTokenizer:
    """Packed ids (little-endian, 32 bits) of whole texts.

    Byte-level merges run on the vocabulary's ranks; texts that hold the string of a special
    token go to the library, which makes it one id.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.path, self.library = path, None
        self.encode = byte_tokens.encoder(path).encode_ordinary

    def _with_special(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def pack(self, text: str) -> bytes:
        found = self._with_special(text) if any(s in text for s in self.special) else self.encode(text)
        return np.array(found, dtype="<u4").tobytes()


@cache
def load(path: str) -> TextTokenizer:
    return TextTokenizer(path)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. Null text is an empty one: it has the end id alone."""
    tail = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = load(tokenizer_path)
        for batch in batches:
            for part in bounded(batch, 1, SLICE):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = made.pack(text.as_py() or "") + tail
                    for k, (start, length) in enumerate(_cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        for column, value in zip(out, (doc, k, start, length, crc), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, PIECES)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, count, first sequence, offset).

    Pieces of `length` with ranks from `first rank` take consecutive sequences.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, left)
                n = left // each
                for k in range(each):
                    placed.append((length, rank + k * n, n, opened, k * length))
                add(capacity - each * length, opened, n)
                opened, rank, left = opened + n, rank + each * n, left - each * n
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            take = min(n, left)
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            add(gap, first + take, n - take)
            placed.append((length, rank, take, first, capacity - gap))
            add(gap - length, first, take)
            rank, left = rank + take, left - take
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5)


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """A rank from 0 inside each length: row numbers of salted parts, moved up by the parts below."""
    parts = max(1, -(-most // RANKED))
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("length").alias("_length"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(
        Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start")
    )
    numbered = salted.withColumn("_in", inside)
    return numbered.join(sums, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_p"))).withColumn(
        "_rank", F.col("_before") + F.col("_in") - 1
    ).drop("_part", "_length", "_p", "_before", "_in")


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with `sequence_id` and `offset`.

    Ids are end-terminated; longer documents are cut into full pieces behind a shorter
    first one. Null ids stay null; repeated rows are packed each; an empty table gives an
    empty result; ties in length go by id.
    """
    rows = written(pieces(docs, tokenizer_path, text, capacity), "pack-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sweep(counts, capacity)
    keys = plan[:, 0] << 44 | plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rank = part.pop("_rank").to_numpy(np.int64)
            row = np.searchsorted(keys, part["length"].to_numpy(np.int64) << 44 | rank, side="right") - 1
            part["sequence_id"] = plan[row, 3] + rank - plan[row, 1]
            part["offset"] = plan[row, 4]
            yield part

    ranked = _ranked(rows, max(counts.values(), default=0))
    return ranked.select(*rows.columns, "_rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
