"""Exact top-k inner products over norm-sorted blocks.

Vectors are range-sorted by descending length into blocks. The longest block answers every
query first and gives each a threshold; by Cauchy-Schwarz a block whose longest vector
cannot reach any query's threshold is dropped unseen, and inside a block the same bound
drops vectors. For the rest the leading coordinates in the SVD basis give a partial sum,
and the lengths of what is left bound the missing part; only vectors that can still win get
their exact integer product. Queries meet blocks in chunks, so memory is bounded by one
chunk and one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import written

SCALE = 256
BLOCK = 4096
CHUNK = 512
LEADING = 24
#: Below this product of lengths every sum of integer products is exact in a double.
_EXACT = 2.0**52


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """key, `v` (floor(scale * x) as long) and `norm`, for vectors of finite components.

    Null keys, null vectors and vectors with a null or non-finite component are left out.
    """
    values = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(
        F.col(vector),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = vectors.where(F.col(vector).isNotNull() & ~bad & F.col(key).isNotNull())
    return usable.select(F.col(key).cast("long").alias("key"), values.alias("v")).withColumn("norm", F.sqrt(squares))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(rows: DataFrame, group: str, width: int) -> DataFrame:
    """One row per group: its keys, row numbers and vectors as bytes, and the largest norm."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["norm", "key", "uid"], ascending=[False, True, True])
        return pd.DataFrame(
            {
                group: [part[group].iloc[0]],
                "keys": [part["key"].to_numpy(np.int64).tobytes()],
                "uids": [part["uid"].to_numpy(np.int64).tobytes()],
                "vectors": [_matrix(part["v"].tolist(), width).tobytes()],
                "longest": [float(part["norm"].max())],
            }
        )

    return rows.groupBy(group).applyInPandas(pack, f"{group} int, keys binary, uids binary, vectors binary, longest double")


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0).to_pylist(), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])

    rows = vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(width * width)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["x"]
    return out.reshape(width, width)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; in doubles (by the matrix library) where no sum can lose a bit."""
    top = np.linalg.norm(q.astype(float)) * np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))
    return (x.astype(float) @ q.astype(float)).astype(np.int64) if top < _EXACT else x @ q


def _best(scores: np.ndarray, keys: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((uids[keep], keys[keep], -scores[keep]))[:k]]


FOUND = "chunk int, query_uid long, query_id long, vec_id long, uid long, score long"


def _search(basis: np.ndarray, k: int):
    """A function over rows of (chunk, block) with what the chunk's queries must beat."""
    lead = min(LEADING, len(basis))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(basis)
        for part in parts:
            for r in part.itertuples():
                q_ids, q_uids = np.frombuffer(r.q_keys, np.int64), np.frombuffer(r.q_uids, np.int64)
                q = np.frombuffer(r.q_vectors, np.int64).reshape(-1, width)
                ids, uids = np.frombuffer(r.keys, np.int64), np.frombuffer(r.uids, np.int64)
                x = np.frombuffer(r.vectors, np.int64).reshape(-1, width)
                floors = dict(zip(r.floor_uids, r.floors, strict=True)) if r.floors is not None else {}
                xr, qr = x @ basis, q @ basis
                x_norm, q_norm = np.sqrt((xr**2).sum(axis=1)), np.sqrt((qr**2).sum(axis=1))
                x_rest = np.sqrt((xr[:, lead:] ** 2).sum(axis=1))
                q_rest = np.sqrt((qr[:, lead:] ** 2).sum(axis=1))
                out: list[tuple] = []
                for i in range(len(q)):
                    floor = floors.get(int(q_uids[i]), -math.inf)
                    slack = 1e-6 * (1 + q_norm[i] * r.longest)
                    # Rows are in descending length: those that can reach the floor come first.
                    n = len(x) if floor <= 0 else int(np.searchsorted(-x_norm, -(floor - slack) / max(q_norm[i], 1e-12), side="right"))
                    if not n:
                        continue
                    bound = xr[:n, :lead] @ qr[i, :lead] + x_rest[:n] * q_rest[i] + slack
                    live = np.flatnonzero((bound >= floor) & (uids[:n] != q_uids[i]))
                    if not len(live):
                        continue
                    scores = _exact(q[i], x[live])
                    for j in _best(scores, ids[live], uids[live], k):
                        out.append((r.chunk, q_uids[i], q_ids[i], ids[live[j]], uids[live[j]], scores[j]))
                yield pd.DataFrame(out, columns=["chunk", "query_uid", "query_id", "vec_id", "uid", "score"])

    return run


def top_products(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """The k highest inner products of each query row with all other rows.

    `is_query` is a condition on `key`. Returns query_id, rank, vec_id, score; ties go to
    the smaller id. Shorter vectors are filled with zeros. A repeated row is a row of its
    own. Fewer candidates than k give fewer rows, an empty table none.
    """
    rows = quantised(vectors, key, vector)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(int(facts["width"] or 1), 1)
    n_blocks = max(1, math.ceil(facts["n"] / block))
    sorted_rows = rows.repartitionByRange(n_blocks, F.desc("norm"), "key").select(
        "*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("uid")
    )
    sorted_rows = written(sorted_rows, "products-sorted")
    blocks = written(_packed(sorted_rows, "block", width), "products-blocks")
    asked = sorted_rows.where(is_query(F.col("key")))
    n_chunks = max(1, math.ceil(asked.count() / chunk))
    chunks = _packed(asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(n_chunks)).cast("int")), "chunk", width)
    chunks = written(
        chunks.select("chunk", F.col("keys").alias("q_keys"), F.col("uids").alias("q_uids"),
                      F.col("vectors").alias("q_vectors"), F.col("longest").alias("q_longest")),
        "products-queries",
    )
    _, basis = np.linalg.eigh(_gram(sorted_rows, width))
    search = _search(np.ascontiguousarray(basis[:, ::-1]), k)
    outline = blocks.select(F.col("block").alias("_block"), "longest")
    first_block = outline.agg(F.max_by("_block", F.struct("longest", -F.col("_block")))).first()[0]
    if first_block is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    no_floor = (F.lit(None).cast("array<long>").alias("floor_uids"), F.lit(None).cast("array<long>").alias("floors"))
    first = chunks.withColumn("block", F.lit(first_block)).join(blocks, "block").select("*", *no_floor)
    found = written(first.mapInPandas(search, FOUND), "products-first")

    per_query = found.groupBy("chunk", "query_uid").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    floors = per_query.where(F.col("n") >= k).groupBy("chunk").agg(
        F.collect_list(F.struct("query_uid", "floor")).alias("_f")
    ).select(F.col("chunk").alias("_chunk"), F.col("_f.query_uid").alias("floor_uids"), F.col("_f.floor").alias("floors"))
    # A block can be left out when even its longest vector stays below every query's floor.
    lowest = F.when(F.size("floors") == F.size("_asked"), F.array_min("floors"))
    asked_uids = asked.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_chunks)).cast("int").alias("_of")).agg(F.collect_list("uid").alias("_asked"))
    ready = (
        chunks.join(floors, F.col("chunk") == F.col("_chunk"), "left")
        .join(asked_uids, F.col("chunk") == F.col("_of"))
        .withColumn("_lowest", lowest)
        .drop("_chunk", "_of", "_asked")
    )
    others = ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks)))).where(F.col("block") != first_block)
    reach = others.join(blocks, "block").where(
        F.col("_lowest").isNull() | (F.col("q_longest") * F.col("longest") * (1 + 1e-9) >= F.col("_lowest"))
    ).drop("_lowest")
    rest = reach.repartition("chunk", "block").mapInPandas(search, FOUND)
    by_score = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return (
        found.unionByName(rest)
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
