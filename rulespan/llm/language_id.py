"""Operator 6: language identification by multinomial naive Bayes.

Features are hashed character n-grams (orders 1 to 3).  Counting is a Spark
job over the whole training fold: every task sums its own counts per language
and bucket, so the shuffle carries at most languages x buckets rows a task.
The log-probability matrix (buckets x languages) is broadcast, and tasks score
slabs of documents by summing its rows at their n-grams, all languages at
once.  Its size is checked: a ``lang`` column with more than ``MOST_LANGUAGES``
values is no language column, and training says so instead of dropping some.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import SLAB_BYTES, crc_mod, slabs

DIMS = 1 << 14
ORDERS = (1, 2, 3)
FOLDS, HELD = 4, 2
ALPHA = 0.5
MOST_LANGUAGES = 1000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and "is a letter" for the code points below 2**16."""
    points = range(1 << 16)
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, points)], np.uint32)
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in points])
    return lower, letter


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of a slab, where each document starts, has it a letter."""
    lower, letter = tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    starts = np.minimum(heads[offsets], len(points))
    small = np.minimum(points, 65535)
    is_letter = np.where(points < 65536, letter[small], False)
    for c in np.unique(points[points >= 65536]):
        is_letter[points == c] = unicodedata.category(chr(c))[0] == "L"
    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(is_letter, out=total[1:])
    return np.where(points < 65536, lower[small], points), starts, total[starts[1:]] > total[starts[:-1]]


def grams(points: np.ndarray, starts: np.ndarray, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram and each document's range of them.

    An n-gram that would cross into the next document is left out.
    """
    shift = np.uint64(64 - int(dims).bit_length() + 1)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(points))
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code * np.uint64(0x100000001B3)
        code[: len(points) - n + 1] += points[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in ORDERS:
            at = np.flatnonzero(left >= n)
            yield ((code[at] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), np.searchsorted(at, starts)


@dataclass(frozen=True)
class BayesModel:
    languages: list[str]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages, log probabilities


def train(docs: DataFrame, dims: int = DIMS, alpha: float = ALPHA) -> BayesModel:
    """Count n-grams of all training rows (known lang, outside the held-out fold)."""
    learned = F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD)
    if (many := docs.filter(learned).select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{many} values of lang; a matrix of {MOST_LANGUAGES} languages at most is broadcast")
    known = docs.filter(learned).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, to, data, offsets in slabs(batch.column("text")):
                points, starts, _ = code_points(data, offsets)
                names, which = np.unique(langs[at:to].astype(str), return_inverse=True)
                sums = np.zeros(len(names) * dims, np.int64)
                for bucket, edges in grams(points, starts, dims):
                    sums += np.bincount(np.repeat(which, np.diff(edges)) * dims + bucket, minlength=len(sums))
                for i, name in enumerate(names):
                    mine = total.setdefault(name, np.zeros(dims + 1, np.int64))
                    mine[:dims] += sums[i * dims : (i + 1) * dims]
                    mine[dims] += np.count_nonzero(which == i)
        for name, sums in total.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["lang", "bucket", "n"])

    found = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(names), dims + 1))
    if names:
        row = np.searchsorted(names, found.column("lang").to_pylist())
        counts[row, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams_of = counts[:, :dims] + alpha
    table = np.log(grams_of / grams_of.sum(1, keepdims=True)).T.astype(np.float32)
    prior = np.log((counts[:, dims] + 1) / (counts[:, dims].sum() + max(1, len(names))))
    return BayesModel(names, prior, np.ascontiguousarray(table))


def language_id(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (doc_id, text, lang).

    ``lang`` is read for training only.  A null text or one without a letter
    is ``und`` at score 0, as is everything when no language could be learned.
    Repeated rows are judged alike; an empty table gives an empty result.
    The score is the posterior of the predicted language.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs, dims)
    names = np.array([*model.languages, "und"], object)
    limit = max(1 << 12, SLAB_BYTES // max(1, len(model.languages)))
    sent = docs.sparkSession.sparkContext.broadcast((model.prior, model.table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, table = sent.value
        for batch in batches:
            which, score = [], []
            for at, to, data, offsets in slabs(batch.column("text"), limit):
                points, starts, letters = code_points(data, offsets)
                if len(names) == 1:
                    which.append(np.zeros(to - at, int))
                    score.append(np.zeros(to - at))
                    continue
                log = np.tile(prior, (to - at, 1))
                for bucket, edges in grams(points, starts, dims):
                    some = np.flatnonzero(np.diff(edges))
                    if len(some):
                        log[some] += np.add.reduceat(table[bucket], edges[:-1][some], axis=0, dtype=np.float64)
                best = log.argmax(1)
                with np.errstate(under="ignore"):
                    posterior = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                which.append(np.where(letters, best, len(names) - 1))
                score.append(np.where(letters, posterior, 0.0))
            label = names[np.concatenate(which)] if which else names[:0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(label, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "held_out", "lang_pred", "score"])

    folds = docs.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text")
    return folds.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
