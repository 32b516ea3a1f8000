"""Operator 4: toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector over sparse word
features serves all ordered thresholds.  Where the labels know only two
grades, the toxic training documents are graded 1, 2, 3 by thirds of the
density of words that mark toxic ones.  These grades order documents by the
evidence in them, not by a judge's severity; P(grade > 0) rests on the labels
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import crc_mod, stage
from rulespan.llm.features import training_rows, word_buckets
from rulespan.llm.quality_pu import sigmoid

DIMS = 1 << 18
ROWS = 8000
FOLDS = 5
GRADES = 4
FEATURES = 600
MIN_DOCUMENTS = 5


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` has a value for each bucket, ``cuts`` ascend."""

    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return sigmoid(score[:, None] - self.cuts[None, :])


def grade_two_levels(toxic: np.ndarray, evidence: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean rows; toxic rows by quantiles of their evidence."""
    y = np.zeros(len(toxic), int)
    if toxic.any():
        edges = np.quantile(evidence[toxic], np.arange(1, grades - 1) / (grades - 1))
        y[toxic] = 1 + np.searchsorted(edges, evidence[toxic], "right")
    return y


def fit_ordinal(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative logits by Adam; cuts stay ordered.

    The first cut is free and the others add softplus gaps to it.
    """
    levels = int(y.max())
    over = (y[:, None] > np.arange(levels)[None, :]).astype(float)
    base = over.mean(0).clip(1e-4, 1 - 1e-4)
    cuts = np.log((1 - base) / base)
    gaps = np.log(np.expm1(np.maximum(1e-3, np.diff(cuts))))
    w = np.concatenate([np.zeros(x.shape[1]), cuts[:1], gaps])
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = x.shape[1]
    for t in range(1, steps + 1):
        step = np.logaddexp(0, w[n + 1 :])
        theta = w[n] + np.concatenate([[0.0], np.cumsum(step)])
        f = (x @ w[:n].astype(np.float32))[:, None] - theta[None, :]
        p = np.hstack([np.ones((len(y), 1)), sigmoid(f), np.zeros((len(y), 1))])
        mass = np.maximum(1e-9, p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1])
        slope = p * (1 - p)
        upper, lower = slope[np.arange(len(y)), y] / mass, slope[np.arange(len(y)), y + 1] / mass
        gf = -(upper - lower) / len(y)
        gt = np.zeros(levels + 2)
        np.add.at(gt, y, upper / len(y))
        np.add.at(gt, y + 1, -lower / len(y))
        gt = gt[1:-1]
        g = np.concatenate([x.T @ gf.astype(np.float32) + ridge * w[:n], [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * sigmoid(w[n + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], w[n] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, w[n + 1 :]))])


def evidence_odds(hits: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the log odds that it speaks for a toxic document, and
    that over its standard error; ``hits`` (clean, toxic) x buckets counts the
    documents that have it, ``documents`` both kinds."""
    rate = (hits + 0.5) / (documents[:, None] + 1)
    odds = np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))
    return odds, odds / np.sqrt((1 / (hits + 0.5)).sum(0))


def bucket_counts(sample: DataFrame, dims: int, least: int = MIN_DOCUMENTS) -> np.ndarray:
    """Clean and toxic documents of ``sample`` (text, y) that have each bucket,
    where ``least`` have it: at most two numbers a bucket come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dims), np.int64)
        for batch in batches:
            side, at = batch.column("y").to_numpy() > 0, 0
            for n, owner, bucket in word_buckets(batch.column("text"), dims):
                mine = side[at : at + n][owner]
                total += np.stack([np.bincount(bucket[mine == s], minlength=dims) for s in (False, True)])
                at += n
        some = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "clean", "toxic"])

    sums = sample.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = sums.filter(F.col("clean") + F.col("toxic") >= least).toArrow()
    out = np.zeros((2, dims))
    for i, c in enumerate(("clean", "toxic")):
        out[i, found.column("bucket").to_numpy()] = found.column(c).to_numpy()
    return out


def picked_features(sample: DataFrame, picked: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, distinct buckets, y) of the rows of ``sample``, sorted; a row
    brings one bit for each picked bucket to the driver."""
    column = np.full(dims, -1)
    column[picked] = np.arange(len(picked))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, sizes = [], []
            for n, owner, bucket in word_buckets(batch.column("text"), dims):
                x, at = np.zeros((n, len(picked)), bool), column[bucket]
                x[owner[at >= 0], at[at >= 0]] = True
                bits += [row.tobytes() for row in np.packbits(x, axis=1)]
                sizes.append(np.bincount(owner, minlength=n))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), pa.array(bits, pa.binary())], names=["y", "size", "x"])

    found = sample.mapInArrow(look, "y int, size long, x binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("y", "x", "size"))))  # in a fixed order
    packed = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), (len(picked) + 7) // 8)
    x = np.unpackbits(packed, axis=1)[:, : len(picked)].astype(np.float32)
    return x, np.array([r[2] for r in rows]), np.array([r[0] for r in rows])


def train(docs: DataFrame, labels: DataFrame, dims: int = DIMS, rows: int = ROWS, grades: int = GRADES, features: int = FEATURES) -> OrdinalModel:
    """Fit on about ``rows`` labelled ids outside the held-out fold.

    Of several texts of one id the first in order counts, so ids that repeat
    add no row.  The sample is written once, buckets are counted by tasks, and
    the driver gets the bits of the ``features`` buckets that tell best.
    """
    fold = crc_mod(F.col("doc_id"), FOLDS) != 0
    known = training_rows(docs, labels, "toxic", fold, rows, 21)
    pool = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = stage(pool.groupBy("doc_id").agg(F.min("text").alias("text"), F.greatest(F.lit(0), F.min("y")).alias("y")).select("text", "y"), "sample")
    kinds = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    documents = np.array([kinds.get(False, 0), kinds.get(True, 0)])
    if not documents.all():
        base = (documents[1] + 1) / (documents.sum() + 10)
        return OrdinalModel(np.zeros(dims, np.float32), np.array([np.log((1 - base) / base)]))
    hits = bucket_counts(sample, dims)
    odds, z = evidence_odds(hits, documents)
    worth = np.where(hits.sum(0) >= MIN_DOCUMENTS, np.abs(z), 0)
    picked = np.argsort(-worth, kind="stable")[: min(features, int((worth > 0).sum()))]
    x, size, y = picked_features(sample, picked, dims)
    if y.max() == 1 and grades > 2:
        strong = np.where((odds[picked] > 0) & (worth[picked] > 4), odds[picked], 0)
        y = grade_two_levels(y > 0, x @ strong / np.maximum(np.log1p(size), 1e-9), grades)
    else:
        y = np.unique(y, return_inverse=True)[1]
    w, cuts = fit_ordinal(x, y)
    weights = np.zeros(dims, np.float32)
    weights[picked] = w
    return OrdinalModel(weights, cuts)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, dims: int = DIMS) -> DataFrame:
    """Grade every whole text of ``docs`` (doc_id, text); one narrow pass, no shuffle.

    Returns doc_id, held_out, severity (the expected grade), grade (the
    likeliest), score = P(grade > 0) and toxic (score >= ``threshold``).  Null
    and empty texts get the score of a document without any known word;
    repeated rows are graded alike; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select("doc_id", "toxic")
    model = train(docs, labels, dims)
    held = crc_mod(F.col("doc_id"), FOLDS) == 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.bincount(owner, model.weights[bucket], minlength=n) for n, owner, bucket in word_buckets(batch.column("text"), dims)]
            above = model.above(np.concatenate(parts) if parts else np.zeros(0))
            levels = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
            arrays = [pa.array(above.sum(1)), pa.array(levels.argmax(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=["doc_id", "held_out", "severity", "grade", "score", "toxic"])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, severity double, grade int, score double, toxic boolean")
