"""MinHash near-duplicates by an inverted join on signature coordinates.

A text is the set of its 5-word shingles; equal sets are one class, and classes are the
nodes that are linked. Every class is posted under each (coordinate, value) of its
signature. Values that only one class has cannot collide and are left out; a class with
fewer than MATCHES others left is done. The rest keep a prefix: with coordinates in the
order of their frequency, two classes that agree in MATCHES of them agree in one of the
first (left - MATCHES + 1) of each, so the most frequent lists are skipped.

A list is read as a star: its centre is the member whose values are the most frequent ones,
which in a group of near copies is the text they were made from. Lists with the same centre
are one star, and every two classes that meet in a list are in its star. Each member is
compared with the centre on the full shingle sets, and the links found are contracted to
components. What a star still holds outside its largest component is then compared with the
whole star: in cells of bounded size, the collisions of signatures are counted coordinate by
coordinate, pairs that can't reach MATCHES any more fall out, and the others are confirmed
on their full sets. A cell gives back only links that join components, so no step writes the
pairs of a list, and no pair of different components that meets in a list is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import written
from seriesloom.llm.components import components
from seriesloom.llm.shingles import scramble, shingle_sets

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
#: Two sets of similarity 0.75 agree in fewer coordinates once in some 100,000 pairs.
MATCHES = 32
#: Members of a cell on either side, and shingles of theirs.
CELL, CELL_SHINGLES = 4096, 4 << 20

_RNG = np.random.default_rng(97)
_FACTOR = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each coordinate's hash, as 32-bit numbers."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _FACTOR + _SHIFT
        np.minimum(best, (part ^ (part >> np.uint64(29))).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, text: str, shingle: int, key: str) -> DataFrame:
    """`doc_id`, `n_shingles`, `node` (a hash of the whole set; null without words) and the
    signature `marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1), shingle)
                marks = np.stack([signature(s) for s in sets])
                size = pa.array([len(s) for s in sets], pa.int64())
                ends = np.arange(0, len(sets) * COORDINATES + 1, COORDINATES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size, node_hashes(sets), pa.ListArray.from_arrays(ends, pa.array(marks.ravel()))],
                    names=["doc_id", "n_shingles", "node", "marks"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, marks array<int>")


def node_hashes(sets: list[np.ndarray]) -> pa.Array:
    """One 64-bit hash for each set, from two sums over its shingles and its size."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([scramble(s ^ np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64)
    size = np.array([len(s) for s in sets], np.uint64)
    return pa.array(scramble(scramble(scramble(one) + two) + size).view(np.int64), mask=size == 0)


def full_sets(docs: DataFrame, live: DataFrame, text: str, shingle: int, key: str) -> DataFrame:
    """`node` and its sorted shingle hashes, as bytes, of the classes in `live` (first_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = shingle_sets(batch.slice(at, 512).column(0), shingle)
                yield pa.RecordBatch.from_arrays(
                    [node_hashes(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"]
                )

    ids = live.select(F.col("first_id").alias("_id"))
    some = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, F.col("_key") == F.col("_id"), "left_semi")
    # Rows that share the id may have other texts: the class is told by its hash.
    found = some.select("_text").mapInArrow(run, "node long, hashes binary").join(live.select("node"), "node", "left_semi")
    return found.dropDuplicates(["node"])


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """`node`, `key` for the prefix of every class that can still have a partner, with `fame`,
    the sum of the lengths of all its lists."""
    key = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = classes.select("node", F.posexplode("marks").alias("at", "value")).select("node", key.alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    both = posted.join(shared, "key")
    ranked = both.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"), F.sum("n").alias("fame")
    )
    prefix = F.slice("own", 1, F.size("own") - matches + 1)
    return ranked.where(F.size("own") >= matches).select("node", "fame", F.explode(prefix.getField("key")).alias("key"))


def stars(posted: DataFrame) -> DataFrame:
    """`centre`, `node`: every class with the centre of every list of its prefix."""
    first = F.struct("fame", F.xxhash64("node").alias("h"), "node")
    centres = posted.groupBy("key").agg(F.max(first).alias("c"), F.count("*").alias("n")).where("n > 1")
    centres = written(centres.select("key", F.col("c.node").alias("centre")), "near-centres")
    return posted.join(centres, "key").select("centre", "node").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                hit.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def collisions(mine: np.ndarray, others: np.ndarray, matches: int) -> np.ndarray:
    """The rows of `others` that agree with `mine` in at least `matches` coordinates.

    The coordinates are merged a few at a time; rows that can't get there any more are skipped.
    """
    rows, agreed = np.arange(len(others)), np.zeros(len(others), np.int64)
    for at in range(0, len(mine), 8):
        agreed += (others[rows, at : at + 8] == mine[at : at + 8]).sum(axis=1)
        open_ = agreed + len(mine) - min(at + 8, len(mine)) >= matches
        if not open_.all():
            rows, agreed = rows[open_], agreed[open_]
    return rows


def cell_links(cell: pa.Table, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links of a cell that join components: probes against all members of the cell."""
    node, component = (cell.column(name).to_numpy() for name in ("node", "component"))
    probe = cell.column("probe").to_numpy()
    marks = cell.column("marks").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    hashes = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell.column("hashes")]
    size = np.array([len(h) for h in hashes], np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    links = []
    targets = np.flatnonzero(~probe)
    for p in np.flatnonzero(probe).tolist():
        near = targets[100 * np.minimum(size[targets], size[p]) >= percent * np.maximum(size[targets], size[p])]
        near = near[collisions(marks[p], marks[near], matches)] if len(near) else near
        own = root(int(component[p]))
        near = [t for t in near.tolist() if root(int(component[t])) != own]
        if not near:
            continue
        every = np.concatenate([hashes[t] for t in near])
        place = np.minimum(np.searchsorted(hashes[p], every), size[p] - 1)
        ends = np.cumsum(size[near])
        total = np.concatenate([[0], np.cumsum(hashes[p][place] == every)])
        common = total[ends] - total[ends - size[near]]
        for k in np.flatnonzero(100 * common >= percent * (size[near] + size[p] - common)).tolist():
            other = root(int(component[near[k]]))
            if other != root(own):
                parent[other] = root(own)
                links.append((int(node[p]), int(node[near[k]])))
    return links


def cells(placed: DataFrame) -> DataFrame:
    """(centre, i, j), node, component, probe: what must still be compared, in bounded cells.

    `placed` has centre, node, size, component. The probes of a star are its members outside
    its largest component; part i of them meets part j of all members in cell (i, j).
    """
    kinds = placed.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    stars_ = kinds.groupBy("centre").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        F.max(F.struct("n", "component", "size")).alias("most"),
    ).where("kinds > 1")

    def parts(n, size):
        return F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_SHINGLES)).cast("int")

    shape = written(
        stars_.select(
            "centre", F.col("most.component").alias("largest"), parts(F.col("n"), F.col("size")).alias("wide"),
            parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("high"),
        ),
        "near-shapes",
    )
    open_ = placed.join(shape, "centre")

    def side(rows: DataFrame, i, j, probe: bool) -> DataFrame:
        return rows.select("centre", "node", "component", "wide", "high", F.lit(probe).alias("probe"), i, j).select(
            "centre", "i", "j", "node", "component", "probe"
        )

    def of(count: str):
        return F.pmod(F.xxhash64("node", F.lit(5)), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    targets = side(open_, each("high").alias("i"), of("wide").alias("j"), False)
    probes = side(open_.where("component <> largest"), of("high").alias("i"), each("wide").alias("j"), True)
    return targets.union(probes)


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with their `component` (their own number where no link has them)."""
    joined = components(links).withColumnRenamed("node", "_node")
    return nodes.join(joined, F.col("node") == F.col("_node"), "left").select(
        *nodes.columns, F.coalesce("component", "node").alias("component")
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES,
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Texts without words (null ones too) are linked with nothing. Rows that share an id hang
    together, whatever their texts. Rows with a null id take no part in linking and are their
    own component (null id, kept). Ids may be of any type with an order. An empty table gives
    an empty result.
    """
    marked = written(sketch(docs, text, shingle, key), "near-sketch")
    usable = marked.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    # Equal sets are one class, whatever their number.
    classes = written(
        usable.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.first("marks").alias("marks"), F.first("n_shingles").alias("size"),
            F.count("*").alias("members"),
        ),
        "near-classes",
    )
    posted = written(postings(classes, matches), "near-postings")
    live = written(classes.join(posted.select("node").distinct(), "node", "left_semi"), "near-live")
    sets = written(full_sets(docs, live, text, shingle, key), "near-sets")
    met = written(stars(posted), "near-stars")

    # Members against their centres.
    sizes = live.select(F.col("node").alias("_node"), F.col("size").alias("_size"))
    pairs = met.where("centre <> node").join(live.select("node", "size"), "node").join(sizes, F.col("centre") == F.col("_node"))
    pairs = pairs.where(100 * F.least("size", "_size") >= percent * F.greatest("size", "_size"))
    links = written(confirmed(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets, percent), "near-links")

    # What the centres leave in different components.
    placed = written(met.join(labelled(live.select("node", "size"), links), "node"), "near-placed")

    def run(group: pa.Table) -> pa.Table:
        found = cell_links(group, matches, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    full = cells(placed).join(live.select("node", "marks").join(sets, "node"), "node")
    more = full.groupBy("centre", "i", "j").applyInArrow(run, "a long, b long")

    # Classes of rows that share an id hang together too.
    nodes = F.array_distinct(F.collect_list("node"))
    shared = usable.select("doc_id", "node").distinct().groupBy("doc_id").agg(nodes.alias("own")).where(F.size("own") > 1)
    same = shared.select(F.col("own")[0].alias("a"), F.explode("own").alias("b"))
    links = written(links.union(more).union(same), "near-links")

    named = written(labelled(classes.select("node", "first_id", "members"), links), "near-named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("members").alias("n"))
    # Documents that are alone need no partner from here.
    ids = written(
        named.join(smallest.where("n > 1"), "component").select(F.col("node").alias("_node"), "component_id"), "near-ids"
    )
    return marked.join(ids, F.col("node") == F.col("_node"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The documents without those that have a smaller id in their component."""
    found = near_duplicates(docs, text, key=key, **how)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")
