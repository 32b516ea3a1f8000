"""Operator 3: a quality classifier from positive and unlabelled documents.

Trusted positives are training documents labelled good; the unlabelled set is
every document of the table.  A linear model f minimises the non-negative
unbiased risk with the squared loss l(z) = (1 - z)^2 / 4,

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

whose minimum is 2 P(good) - 1.  Both expectations need only first and second
moments of the features, so one pass of tasks sums them over all rows, in
whole numbers, and the driver sees two small matrices at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import crc_mod, plain_names
from rulespan.llm.features import ONE, quality_features, quality_size, training_rows

DIMS = 8
POSITIVES = 3000
FOLDS = 5
THRESHOLD = 0.3
RIDGE = 1e-4
TOLERANCE = 0.1


@dataclass(frozen=True)
class LinearModel:
    """f = features @ weights; the last feature is constant."""

    weights: np.ndarray
    prior: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def chance(f: np.ndarray, edge: float = 0.02) -> np.ndarray:
    """The chance (1 + f) / 2 of label 1, bent to stay within 0 and 1 beyond ``edge``."""
    p = (1 + f) / 2
    low, high = np.minimum(p, edge), np.maximum(p, 1 - edge)
    return np.where(p < edge, edge * np.exp(np.maximum(low / edge - 1, -50)), np.where(p > 1 - edge, 1 - edge * np.exp(np.maximum((1 - high) / edge - 1, -50)), p))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, trusted: int, ridge: float = RIDGE, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of least risk from the mean outer products of the features.

    With the squared loss the unbiased risk is a quadratic form with one
    minimum.  A negative estimate of the risk on negatives, beyond an
    allowance for the draw of ``trusted`` rows, means the weights fit the
    sample and not the classes; the ridge, in units of each feature's
    variance, then grows until the estimate is back.
    """
    least = -tolerance * len(positive) / trusted
    p, u = positive[-1], unlabelled[-1]
    spread = np.maximum(np.diag(unlabelled) - u * u, 1e-12)
    spread[-1] = 0
    while True:
        # prior E_p[l(f) - l(-f)] = -prior w.p, and E_u[l(-f)] = (1 + 2 w.u + w'Uw) / 4
        w = np.linalg.solve(unlabelled / 2 + np.diag(2 * ridge * spread + 1e-12), prior * p - u / 2)
        negative = (1 + 2 * w @ u + w @ unlabelled @ w) / 4 - prior * (1 + 2 * w @ p + w @ positive @ w) / 4
        if negative >= least or ridge > 1e3:
            return w
        ridge *= 2


def moments(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed outer products of the features of the rows of ``rows`` (text, p)
    that are positive, and of all rows."""
    size = quality_size(dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size), np.int64)
        for batch in batches:
            x = quality_features(batch.column("text"), dims)
            p = x[batch.column("p").to_numpy(zero_copy_only=False)]
            total += np.stack([p.T @ p, x.T @ x]).astype(np.int64)  # whole numbers below 2**53: exact
        cell = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[0].ravel()[cell]), pa.array(total[1].ravel()[cell])], names=["cell", "p", "u"])

    found = rows.mapInArrow(sums, "cell int, p long, u long").groupBy("cell").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    out = np.zeros((2, size * size))
    for i, c in enumerate(("p", "u")):
        out[i, found.column("cell").to_numpy()] = found.column(c).to_numpy()
    return out[0].reshape(size, size), out[1].reshape(size, size)


def train(docs: DataFrame, labels: DataFrame, dims: int = DIMS, positives: int = POSITIVES) -> LinearModel:
    """Fit on all rows as unlabelled and about ``positives`` trusted ids.

    Labels are read for training only, and never those of the held-out fold.
    The prior is the share of good ones among the labelled training rows,
    which takes these for a random draw of the table.  Without a trusted
    positive the model is constant at the prior.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    fold = crc_mod(F.col("doc_id"), FOLDS) != 0
    known = labels.filter(fold).filter("quality is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good")).first()
    prior = min(0.98, max(0.02, (known["good"] + 1) / (known["n"] + 2)))
    trusted = training_rows(docs, labels.filter("quality = 1"), "quality", fold, positives, 11)
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", F.col("y").isNotNull().alias("p"))
    positive, unlabelled = moments(rows, dims)
    if not positive[-1, -1]:
        weights = np.zeros(len(positive))
        weights[-1] = (2 * prior - 1) / ONE
        return LinearModel(weights, prior)
    return LinearModel(fit_nnpu(positive / positive[-1, -1], unlabelled / unlabelled[-1, -1], prior, int(positive[-1, -1] / ONE**2)) / ONE, prior)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, dims: int = DIMS) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) in one narrow pass.

    Returns doc_id, held_out, score, predicted.  Null and empty texts score as
    texts without any feature; repeated rows are scored alike; a null id
    counts as the empty text when folds are told apart; an empty table gives
    an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = train(docs, labels, dims).weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = chance(quality_features(batch.column("text"), dims) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    folds = docs.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return folds.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def quality_rejects(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, dims: int = DIMS) -> DataFrame:
    """``docs`` without the rows that the classifier scores below ``threshold``.
    Columns of any name pass through."""
    text = F.col("text").cast("string")
    weights = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), labels, dims).weights
    names, schema = plain_names(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = chance(quality_features(batch.column(len(names)), dims) @ weights)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(s >= threshold))

    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), text).toDF(*names, "text")
    return rows.mapInArrow(keep, schema).toDF(*docs.columns)
