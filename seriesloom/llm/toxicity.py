"""Toxicity by two class-conditional Kneser-Ney models over letters.

Letters are folded to a small alphabet, so all 4-grams fit a table of fixed size. Each
class (toxic, ordinary) has its own 4-gram counts; what a class has not seen is smoothed by
lower orders whose continuation counts come from both classes together, so a rare
expression weighs only as much as the classes' own evidence for it. The two log-likelihoods
are compared letter by letter; a text's evidence is its highest length-normalised
difference over passages of PASSAGE letters, so a toxic passage in a long text stays
visible. A logistic curve turns the evidence into a score; it is fitted on labelled rows
kept out of the counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
LETTERS = 40
CELLS = LETTERS**ORDER
PASSAGE = 40
#: Labels are broadcast up to this many rows (some 50 MB) and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Cells of the evidence histogram to which the logistic curve is fitted.
BINS = 400
RANGE = 4.0

_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Symbol of each character of the first plane: 0 space, 1 digit, 2 other, 3-28 base
    letters a-z without accents, 29-39 further letters by code point."""
    if not _FOLD:
        table = np.full(0x10001, 2, dtype=np.uint8)
        for code in range(0x10000):
            c = chr(code)
            if c.isspace():
                table[code] = 0
            elif c.isdigit():
                table[code] = 1
            elif c.isalpha():
                base = unicodedata.normalize("NFKD", c)[0].lower()[0]
                table[code] = 3 + ord(base) - 97 if "a" <= base <= "z" else 29 + code % 11
        _FOLD.append(table)
    return _FOLD[0]


def codes(text: str | None) -> np.ndarray:
    """Cell of the 4-gram that ends at each letter; the text begins after three spaces."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")
    symbols = np.zeros(len(points) + ORDER - 1, dtype=np.int64)
    symbols[ORDER - 1 :] = fold_table()[np.minimum(points, 0x10000)]
    cell = symbols[: len(points)].copy()
    for k in range(1, ORDER):
        cell = cell * LETTERS + symbols[k : k + len(points)]
    return cell


def count(labelled: DataFrame, text: str = "text", label: str = "toxic") -> DataFrame:
    """`cell`, `n_toxic`, `n_ordinary` over all labelled rows: at most CELLS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(seen[0 if toxic else 1], codes(body), 1)
        cells = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(seen[0, cells]), pa.array(seen[1, cells])], names=["cell", "n_toxic", "n_ordinary"]
        )

    parts = labelled.select(text, label).mapInArrow(run, "cell long, n_toxic long, n_ordinary long")
    return parts.groupBy("cell").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _interpolate(counts: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    """Kneser-Ney step: discounted counts plus the freed mass spread by the lower order."""
    total = counts.sum(axis=-1, keepdims=True)
    kinds = (counts > 0).sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.maximum(counts - discount, 0) / total
        spread = discount * kinds / total
    return np.where(total > 0, own + spread * lower, lower)


def log_ratio(n_toxic: np.ndarray, n_ordinary: np.ndarray) -> np.ndarray:
    """log P(letter | toxic) - log P(letter | ordinary) for every cell."""
    shape = (LETTERS,) * ORDER
    both = (n_toxic + n_ordinary).reshape(shape)
    kinds = [both]
    while kinds[-1].ndim > 1:
        kinds.append((kinds[-1] > 0).sum(axis=0))
    shared = np.full(LETTERS, 1 / LETTERS)
    for continuation in reversed(kinds[1:]):
        shared = _interpolate(continuation, shared, _discount(continuation))
    discount = _discount(both)
    of = [_interpolate(n.reshape(shape), shared, discount) for n in (n_toxic, n_ordinary)]
    return (np.log(of[0]) - np.log(of[1])).astype(np.float32).ravel()


def evidence(ratio: np.ndarray, text: str | None) -> float:
    steps = ratio[codes(text)]
    if not len(steps):
        return 0.0
    if len(steps) <= PASSAGE:
        return float(steps.mean())
    sums = np.concatenate([[0.0], np.cumsum(steps, dtype=np.float64)])
    return float((sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE)


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """The documents with `_evidence` in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [evidence(shared.value, t) for t in batch.column(at).to_pylist()]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(found, pa.float64())], names=[*names, "_evidence"]
            )

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema if f.name != text]).add("_evidence", "double"))


def fit_curve(weighed: DataFrame, label: str = "toxic") -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on a histogram of BINS cells."""
    cell = F.floor((F.col("_evidence") + RANGE) / (2 * RANGE) * BINS)
    rows = (
        weighed.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), cell)).alias("cell"))
        .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("hits"))
        .collect()
    )
    n = np.array([r["n"] for r in rows], dtype=float)
    hits = np.array([r["hits"] for r in rows], dtype=float)
    if not n.sum() or not 0 < hits.sum() < n.sum():
        return 1.0, 0.0
    x = np.stack([(np.array([r["cell"] for r in rows]) + 0.5) / BINS * 2 * RANGE - RANGE, np.ones(len(rows))], axis=1)
    w = np.array([1.0, float(np.log(hits.sum() / (n - hits).sum()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (hits - n * p) - 1e-3 * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> DataFrame:
    """Documents that have a label: doc_id, text, toxic (the highest of several labels)."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).alias(label))
    )
    if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select("doc_id", text).join(known, F.col("doc_id") == F.col("_id")).drop("_id")


def learn(
    docs: DataFrame, labels: DataFrame, fold: Column, text: str = "text", label: str = "toxic"
) -> tuple[np.ndarray, tuple[float, float]]:
    """Log ratios and curve from the labelled documents: fold 0 fits the curve, the others the counts."""
    known = labelled(docs, labels, text, label).withColumn("_fold", fold)
    table = count(known.where("_fold <> 0"), text, label).toPandas()
    n = np.zeros((2, CELLS))
    n[:, table["cell"].to_numpy(dtype=np.int64)] = table[["n_toxic", "n_ordinary"]].to_numpy(dtype=float).T
    ratio = log_ratio(n[0], n[1])
    return ratio, fit_curve(weigh(known.where("_fold = 0").select(text, label), ratio, text), label)


def score(docs: DataFrame, model: tuple[np.ndarray, tuple[float, float]], text: str = "text") -> DataFrame:
    """The documents, without the text, with `score` and `predicted`.

    Null and empty texts have no evidence and get the curve's value at 0. Repeated rows are
    scored each; an empty table gives an empty result; without labels every text scores at
    the curve's value. Columns of the result's names are replaced.
    """
    ratio, (slope, offset) = model
    curve = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), slope * F.col("_evidence") + offset))))
    return (
        weigh(docs.drop("score", "predicted"), ratio, text)
        .withColumn("score", curve)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .drop("_evidence")
    )


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, tuple[float, float]], text: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    ratio, (slope, offset) = model
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            clean = [slope * evidence(shared.value, t) + offset < 0 for t in bodies]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
