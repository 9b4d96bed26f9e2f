"""Long repeats by run-length indexes over anchored contexts.

Every 400-byte window is owned by its anchor, the 128-byte string of least hash inside it
(the leftmost of equals); equal windows have equal anchors at equal places. Windows of one
anchor occurrence are a run of starts, and the bytes they cover are its region. Anchors
that occur once own no repeat. Equal regions are counted, not compared: all their windows
repeat. What is left are anchors with several different regions, and those are indexed.

The index of such an anchor is the run-length Burrows-Wheeler transform of its regions. It is
built column by column: the regions are sorted by what follows the anchor, with the length
of the match between neighbours; one LF step moves every row one byte to the left, sorted
by (byte to the left, place before). Rows of one byte are a run, at whose inner borders the
match length is 1 + the least one between its rows' old places, and at whose ends it is 0.
Streaming these steps gives the matching statistics of every window start; a start with a
match of 400 bytes or more is marked. Rows that can no longer reach 400 leave the index, so
the work follows the repeats. Indexes of many anchors are stepped together in one bucket of
bounded size; an anchor with more regions than fit a bucket is counted window by window in
a distributed aggregate instead, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import written
from seriesloom.llm.shingles import _BYTE, scramble, text_bytes

LENGTH = 400
ANCHOR = 128
#: Regions that are indexed together, and regions of one anchor that still are.
BUCKET = 6_000
HOT = 60_000
#: Bytes of text that a task hashes at a time (one longer text is taken whole).
CHUNK = 1 << 21
#: Anchors that hold more than this many rows, or this share of all, are joined apart.
HEAVY = 1 << 14
HEAVY_KEYS = 100_000

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 28) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def sample_of(length: int, anchor: int) -> int:
    """Bytes of the shortest string that always holds an anchor: 256 for windows of 400."""
    return max(anchor, length * 16 // 25)


class _Hasher:
    """Hashes of any part of a byte string, from its running sums."""

    def __init__(self, room: int = 0):
        self.up, self.down = _powers(_BASE, room), _powers(_BACK, room)

    def read(self, body: np.ndarray) -> np.ndarray:
        if len(body) >= len(self.up):
            self.__init__(len(body) + 1)
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE[body] * self.up[: len(body)], out=sums[1:])
        return sums

    def part(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((sums[end] - sums[start]) * self.down[start])


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least gram of every `width` neighbours, with its place in the low bits."""
    least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return least


def _owners(grams: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, place, first start, last start) of the anchors of all `length`-byte windows."""
    # Window starts whose window ends inside the same text.
    room = np.maximum(np.diff(at) - length + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    if not len(text):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    starts = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + at[:-1][text]
    place = (_least(grams, length - anchor + 1)[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(text) != 0)))
    last = np.append(first[1:], len(starts)) - 1
    return text[first], place[first], starts[first], starts[last]


def find_anchors(
    hasher: _Hasher, body: np.ndarray, at: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, sample: int | None = None
):
    """Arrays (text, anchor hash, place, first start, last start, region hash), places within the text.

    Anchors of `sample`-byte windows that own no `length`-byte window have first start -1.
    """
    if len(body) > int(_PLACE):
        raise ValueError(f"a text of {len(body)} bytes is longer than {int(_PLACE)}")
    sample = sample_of(length, anchor) if sample is None else sample
    if len(body) < sample:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = hasher.read(body)
    grams = scramble((sums[anchor:] - sums[:-anchor]) * hasher.down[: len(body) - anchor + 1])
    text, p, lo, hi = _owners(grams, at, length, anchor)
    region = hasher.part(sums, lo, hi + length) ^ scramble(((p - lo) << 20 | (hi - lo)).astype(np.uint64))
    more_text, more, _, _ = _owners(grams, at, sample, anchor)
    new = ~np.isin(more, p)
    none = np.full(int(new.sum()), -1)
    begin = at[:-1][text]
    places = np.append(p, more[new])
    texts = np.append(text, more_text[new])
    return (
        texts, grams[places].view(np.int64), places - at[:-1][texts], np.append(lo - begin, none),
        np.append(hi - begin, none), np.append(region.view(np.int64), np.zeros(len(none), np.int64)),
    )


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK bytes of text, or one row."""
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


ANCHORS = "key long, a long, p int, lo int, hi int, r long"


def anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row per anchor occurrence of `docs` (key, text); without region where it owns no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for part in _chunks(batch, 1):
                text, a, p, lo, hi, r = find_anchors(hasher, *text_bytes(part.column(1)), length, anchor)
                keys = part.column(0).to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
                none = lo < 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(p, pa.int32()),
                     pa.array(lo, pa.int32(), mask=none), pa.array(hi, pa.int32(), mask=none), pa.array(r, pa.int64(), mask=none)],
                    names=["key", "a", "p", "lo", "hi", "r"],
                )

    return docs.select("key", "text").mapInArrow(run, ANCHORS)


def step_index(groups: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Marks [row, d]: the window that starts d bytes before the anchor occurs in another row
    of its group.

    `left` holds the bytes before the anchor from right to left, `right` those from the
    anchor on; a row owns the windows of d from `low` to `high`.
    """
    marks = np.zeros((len(groups), int(high.max(initial=0)) + 1), bool)
    if not len(groups):
        return marks
    columns = right.view(">u8").astype(np.uint64)
    rows = np.lexsort((*[columns[:, k] for k in range(columns.shape[1] - 1, -1, -1)], groups))
    differ = right[rows[1:]] != right[rows[:-1]]
    match = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    room = length - low
    match = np.minimum(match, np.minimum(room[rows[1:]], room[rows[:-1]]))
    lcp = np.append(0, np.where(groups[rows[1:]] == groups[rows[:-1]], match, 0))
    for d in range(marks.shape[1]):
        best = np.maximum(lcp, np.append(lcp[1:], 0))
        marks[rows, d] = (best >= length) & (d >= low[rows]) & (d <= high[rows])
        stay = np.flatnonzero((high[rows] > d) & (best + high[rows] - d >= length))
        if not len(stay):
            break
        run = groups[rows[stay]] << 8 | left[rows[stay], d]
        order = np.argsort(run, kind="stable")
        run, place = run[order], stay[order]
        inner = run[1:] == run[:-1]
        ends = np.stack([place[:-1] + 1, place[1:] + 1], axis=1)[inner].ravel()
        after = np.zeros(len(place), np.int64)
        if len(ends):
            after[1:][inner] = 1 + np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
        rows, lcp = rows[place], after
    return marks


MARKS = "a long, r long, from_d int, to_d int"


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true cells in each row."""
    wide = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    wide[:, 1:-1] = marks
    change = np.diff(wide, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def _index_bucket(length: int, anchor: int):
    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["a", "r"]).sort_values(["a", "r"]).reset_index(drop=True)
        groups = part["a"].ne(part["a"].shift()).cumsum().to_numpy(np.int64)
        low, high = part["low"].to_numpy(np.int64), part["high"].to_numpy(np.int64)
        wide = length - anchor
        left = np.zeros((len(part), wide + 1), np.int64)
        right = np.zeros((len(part), -(-length // 8) * 8), np.uint8)
        for i, (body, h) in enumerate(zip(part["body"], high.tolist(), strict=True)):
            region = np.frombuffer(body, np.uint8)
            left[i, :h] = region[:h][::-1]
            right[i, : len(region) - h] = region[h:]
        row, first, last = _runs(step_index(groups, left, right, low, high, length))
        return pd.DataFrame({"a": part["a"].to_numpy()[row], "r": part["r"].to_numpy()[row], "from_d": first, "to_d": last})

    return index


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted region, cut from the text of one document that has it."""
    lists = wanted.groupBy(F.col("rep.key").alias("of")).agg(
        F.collect_list(F.struct("a", "r", F.col("rep.p").alias("p"), F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"))).alias("cuts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "r", "low", "high", "body"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(0)[i].as_py().encode()
                cuts = batch.column(1)[i].as_py()
                rows = [(c["a"], c["r"], c["p"] - c["hi"], c["p"] - c["lo"], body[c["lo"] : c["hi"] + length]) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.join(lists, F.col("key") == F.col("of")).select("text", "cuts").mapInArrow(
        run, "a long, r long, low int, high int, body binary"
    )


def _window_counts(bodies: DataFrame, length: int) -> DataFrame:
    """Marks of anchors with very many regions, by a count of every window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(4 * length)
        for batch in batches:
            for row in batch.to_pylist():
                body = np.frombuffer(row["body"], np.uint8)
                sums = hasher.read(body)
                start = np.arange(len(body) - length + 1)
                window = hasher.part(sums, start, start + length).view(np.int64)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["a"])), pa.array(np.full(n, row["r"])),
                     pa.array((row["high"] - start).astype(np.int32)), pa.array(window)],
                    names=["a", "r", "d", "w"],
                )

    windows = bodies.dropDuplicates(["a", "r"]).mapInArrow(run, "a long, r long, d int, w long")
    often = windows.groupBy("a", "d", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(often, ["a", "d", "w"]).select("a", "r", F.col("d").alias("from_d"), F.col("d").alias("to_d"))


def _heavy(sizes: DataFrame, total: int, size: str, on: list[str]) -> DataFrame:
    """Keys that hold more than HEAVY rows and more than one row of HEAVY_KEYS: at most HEAVY_KEYS keys."""
    return sizes.where(F.col(size) > max(HEAVY, total // HEAVY_KEYS)).select(*on)


def _spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """Inner join with one row of `right` per key; rows of heavy keys stay where they are."""
    if heavy.isEmpty():
        return left.join(right, on)
    few = F.broadcast(heavy)
    rest = left.join(few, on, "left_anti").join(right, on)
    return rest.unionByName(left.join(F.broadcast(right.join(few, on, "left_semi")), on))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """For `docs` (key, text): `spans`, the byte ranges [from, to) of repeated windows, and `n_shared`,
    the number of anchors that start elsewhere too. Keys with neither have no row."""
    found = written(anchors(docs, length, anchor), "repeat-anchors")
    total = found.count()
    twice = written(
        found.groupBy("a").agg(F.count("*").alias("n"), F.coalesce(F.min("r") != F.max("r"), F.lit(False)).alias("several")).where("n > 1"),
        "repeat-twice",
    )
    live = written(_spread_join(found, twice.drop("n"), ["a"], _heavy(twice, total, "n", ["a"])), "repeat-live")
    owning = live.where("r is not null")
    regions = written(
        owning.groupBy("a", "r").agg(
            F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("key", "p", "lo", "hi")).alias("rep")
        ),
        "repeat-regions",
    )
    whole = regions.where("n > 1").select(
        "a", "r", (F.col("rep.p") - F.col("rep.hi")).alias("from_d"), (F.col("rep.p") - F.col("rep.lo")).alias("to_d")
    )
    open_ = regions.where("several")
    kinds = open_.groupBy("a").agg(F.count("*").alias("kinds"))
    n_open = open_.count()
    bodies = written(_bodies(docs, open_, length), "repeat-bodies")
    sized = _spread_join(bodies, kinds, ["a"], _heavy(kinds, n_open, "kinds", ["a"]))
    n_buckets = max(1, math.ceil(n_open / bucket))
    cold = sized.where(F.col("kinds") <= hot).withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(n_buckets)).cast("int"))
    marks = cold.groupBy("bucket").applyInPandas(_index_bucket(length, anchor), MARKS)
    if not kinds.where(F.col("kinds") > hot).isEmpty():
        marks = marks.union(_window_counts(sized.where(F.col("kinds") > hot), length))
    marks = written(
        whole.union(marks).groupBy("a", "r").agg(F.collect_list(F.struct("from_d", "to_d")).alias("marks")), "repeat-marks"
    )
    shift = lambda m: F.struct((F.col("p") - m["to_d"]).alias("from"), (F.col("p") - m["from_d"] + length).alias("to"))
    spans = _spread_join(owning.select("key", "a", "r", "p"), marks, ["a", "r"], _heavy(regions, total, "n", ["a", "r"])).select(
        "key", F.lit(None).cast("int").alias("place"), F.transform("marks", shift).alias("spans")
    )
    seen = live.select("key", F.col("p").alias("place"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    # Equal rows share a key: sets, so that their spans are held once.
    return spans.union(seen).groupBy("key").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.size(F.collect_set("place")).cast("long").alias("n_shared")
    )


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """The documents, without the text, with n_bytes, n_removed, n_spans, `kept_bytes` and n_shared.

    Bytes covered by a `length`-byte string that starts anywhere else too, in any document,
    are removed; strings are judged on the input. Null texts are empty. Repeated rows repeat
    each other's text and so lose it, if it is long enough. An empty table gives an empty
    result. Columns of the result's names are replaced. Texts above 2^28 bytes raise an error.

    `n_shared` removes nothing. It counts the document's anchors (128-byte strings) that start
    elsewhere too. Every 256-byte string holds an anchor, chosen by the string alone, so a
    document with a passage of 256 bytes or more that occurs elsewhere has at least one.
    """
    results = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_bytes": "binary", "n_shared": "long"}
    names = [c for c in docs.columns if c not in {*results, text}]
    # Equal rows share a key and thereby their spans.
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ids = [f"_c{i}" for i, c in enumerate(names) if c == "doc_id"]
    keyed = keyed.withColumn("key", F.xxhash64(*ids, "text"))
    found = repeats(keyed, length=length, **how).withColumnRenamed("key", "_key")
    joined = keyed.join(found, F.col("key") == F.col("_key"), "left").drop("key", "_key")
    joined = joined.fillna(0, ["n_shared"])
    kept = joined.columns[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = body.as_py().encode()
                gone = _merge(spans.as_py())
                at, rest = 0, []
                for a, b in gone:
                    rest.append(raw[at:a])
                    at = b
                rest.append(raw[at:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), b"".join(rest)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                + [batch.column("n_shared")],
                names=[*kept, *results],
            )

    schema = T.StructType([joined.schema[c] for c in kept])
    for name, kind in results.items():
        schema = schema.add(name, kind)
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *results)
