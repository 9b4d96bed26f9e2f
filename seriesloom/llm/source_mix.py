"""Mixing sources to target weights by the cube method.

Every document of a source gets the same expected number of copies, target / source size.
Whole copies are certain; the fraction is an inclusion probability. A flight moves these
probabilities inside the null space of two constraints, the number of documents and the
number of tokens of the source, until each is 0 or 1 but for a few. Sources are cut into
blocks of bounded size; what each block leaves open meets in fewer blocks, and so on, until
one small landing problem per source remains, which is solved by trying all its outcomes.
Documents that hold a large share of their source are landed first, and the others make up
for what that misses: no landing of theirs could.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import same, word_count, written

#: Weights of the sources in code-point order, repeating; share and limit of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0

BLOCK = 1024
#: Documents that one flight moves at a time, and those left to the landing.
WINDOW = 32
LANDING = 8
#: Units of at least 1 / HEAVY of their source's words are landed first: at most so many per source.
HEAVY = 64
_EPS = 1e-9


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: `source`, `source_size`, `n_units`, `target`.

    The mix takes share * all sizes, dealt by weight; a source above limit * its size stops
    there and the excess goes to the others by weight. With r = limit * size / weight, the
    stopped sources are a prefix in the order of r. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    most = F.col("source_size") * limit
    leveled = (
        per.withColumn("_w", weight)
        .withColumn("_r", most / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * share)
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_k", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_k", "_level"))).over(everything)
    level = F.coalesce(first["_level"], F.lit(math.inf))
    return leveled.select(
        "source", "source_size", "n_units", F.least(most, level * F.col("_w")).cast("double").alias("target")
    )


def _steps(pi: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """How far pi can go along u, forward and backward, inside [0, 1]."""
    up, down = u > _EPS, u < -_EPS
    ahead = np.concatenate([(1 - pi[up]) / u[up], -pi[down] / u[down]])
    back = np.concatenate([pi[up] / u[up], (pi[down] - 1) / u[down]])
    return float(ahead.min()), float(back.min())


def _direction(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """A move of the largest document that the others make good: both totals stay."""
    basis = []
    for row in (counts / np.linalg.norm(counts), sizes):
        rest = row - sum((row @ b) * b for b in basis)
        norm = np.linalg.norm(rest)
        if norm > 1e-7 * max(np.linalg.norm(row), 1.0):
            basis.append(rest / norm)
    for k in range(len(sizes)):
        u = -sum(b[k] * b for b in basis)
        u[k] += 1
        if np.abs(u).max() > 1e-6:
            u[np.abs(u) < 1e-9] = 0
            return u
    return None


def flight(pi: np.ndarray, sizes: np.ndarray, counts: np.ndarray, rng: np.random.Generator, leave: int = LANDING) -> np.ndarray:
    """Move the probabilities until at most `leave` of them (or none that can move) are open."""
    pi = pi.copy()
    order = np.argsort(-sizes, kind="stable")
    queue = [i for i in order if _EPS < pi[i] < 1 - _EPS]
    live: list[int] = []
    at = 0
    while True:
        while len(live) < WINDOW and at < len(queue):
            live.append(queue[at])
            at += 1
        if len(live) <= leave and at == len(queue):
            break
        idx = np.array(live)
        u = _direction(sizes[idx], counts[idx]) if len(idx) > 2 else None
        if u is None:
            break
        ahead, back = _steps(pi[idx], u)
        step = ahead if rng.random() * (ahead + back) < back else -back
        pi[idx] = np.clip(pi[idx] + step * u, 0, 1)
        pi[idx[pi[idx] < _EPS]] = 0
        pi[idx[pi[idx] > 1 - _EPS]] = 1
        live = [i for i in live if 0 < pi[i] < 1]
    return pi


def land(pi: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Round the open probabilities: of all outcomes that with the nearest token total,
    then the nearest document total. More than 12 open ones (equal sizes) are first rounded
    from the largest down, each against the sum of errors so far."""
    pi = pi.copy()
    open_ = [i for i in np.argsort(-sizes, kind="stable") if 0 < pi[i] < 1]
    error = 0.0
    while len(open_) > 12:
        i = open_.pop(0)
        up = abs(error + (1 - pi[i]) * sizes[i]) <= abs(error - pi[i] * sizes[i])
        error += (up - pi[i]) * sizes[i]
        pi[i] = float(up)
    if open_:
        choices = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
        tokens = np.abs(error + (choices - pi[open_]) @ sizes[open_])
        docs = np.abs((choices - pi[open_]) @ counts[open_])
        pi[open_] = choices[np.lexsort((docs, np.round(tokens, 6)))[0]]
    return pi


def _round(last: bool):
    def move(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_size", "_hash"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(repr(key).encode()))
        sizes, counts = part["_size"].to_numpy(float), part["n"].to_numpy(float)
        pi = flight(part["_pi"].to_numpy(float), sizes, counts, rng)
        part["_pi"] = land(pi, sizes, counts) if last else pi
        return part

    return move


def _land_heavy(state: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """The other units with the share that reaches the target, and the landed large ones."""
    large = (F.col("_size") > 0) & (F.col("_size") * HEAVY >= F.col("source_size"))
    heavy = written(state.where(large).groupBy("source").applyInPandas(_round(True), state.schema), "mix-heavy")
    used = heavy.groupBy(F.col("source").alias("_of")).agg(
        F.sum((F.col("_whole") + F.col("_pi")) * F.col("_size")).alias("_used"), F.sum("_size").alias("_held")
    )
    left = F.col("source_size") - F.col("_held")
    rate = F.when(left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(limit)), (F.col("target") - F.col("_used")) / left)))
    close = F.round(rate, 9)
    rest = state.where(~large).join(used, same(F.col("source"), F.col("_of")), "left").withColumns(
        {
            "_whole": F.coalesce(F.floor(close).cast("int"), "_whole"),
            "_pi": F.coalesce(close - F.floor(close), "_pi"),
        }
    )
    return written(rest.select(*state.columns), "mix-rest"), heavy


def decide(sizes: DataFrame, **how) -> DataFrame:
    """Copies per document: doc_id, source, size, source_size, target, copies.

    `sizes` has doc_id, source and size. Rows that repeat all three are one unit, drawn
    together. Null ids and sources are values like any other. A source without words gets
    no copies; a source of a few large documents comes as near as whole copies allow. Reruns give the same draw: order and randomness come from the rows alone.
    """
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    goal = targets(sizes, **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    close = F.round(rate, 9)
    goal = goal.withColumn("_whole", F.floor(close).cast("int")).withColumn("_part", close - F.floor(close))
    goal = goal.withColumnRenamed("source", "_source")
    state = units.join(goal, same(F.col("source"), F.col("_source"))).drop("_source").select(
        "doc_id", "source", "size", "n", "source_size", "n_units", "target", "_whole",
        F.col("_part").alias("_pi"), (F.col("size") * F.col("n")).alias("_size"),
        F.xxhash64("doc_id", "size").alias("_hash"),
    )
    state = written(state, "mix-units")
    state, heavy = _land_heavy(state, how.get("limit", LIMIT))
    most = state.agg(F.max("n_units")).first()[0] or 0
    done: list[DataFrame] = [heavy]
    at_most, left = F.col("n_units"), most
    turn = 0
    while True:
        is_open = (F.col("_pi") > 0) & (F.col("_pi") < 1)
        done.append(state.where(~is_open))
        last = left <= BLOCK
        blocks = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(at_most / BLOCK)).cast("int")
        dealt = state.where(is_open).withColumn("_block", F.pmod(F.xxhash64("_hash", F.lit(turn)), blocks))
        moved = dealt.groupBy("source", "_block").applyInPandas(_round(last), dealt.schema).drop("_block")
        state = written(moved, "mix-round")
        if last:
            done.append(state)
            break
        # A block leaves at most WINDOW units open (equal sizes), mostly LANDING.
        at_most, left = F.ceil(at_most / BLOCK) * WINDOW, math.ceil(left / BLOCK) * WINDOW
        turn += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") + F.round("_pi").cast("int")).alias("copies"),
    )


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Documents repeated as often as the mix takes them; columns are those of `docs`.

    Empty tables give an empty result; other columns pass through.
    """
    chosen = decide(written(sized(docs, text), "mix-sizes"), **how).where(F.col("copies") > 0).select(
        F.col("doc_id").alias("_mix_id"),
        F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"),
        F.col("copies").alias("_mix_copies"),
    )
    body = docs.withColumn("_mix_words", word_count(F.col(text)))
    match: Column = (
        same(F.col("doc_id"), F.col("_mix_id"))
        & same(F.col("source"), F.col("_mix_source"))
        & (F.col("_mix_words") == F.col("_mix_size"))
    )
    return (
        body.join(chosen, match)
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
