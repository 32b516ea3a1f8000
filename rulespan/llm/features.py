"""Sparse text features of the trained operators, and bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import SLAB_BYTES, U64, Slab, byte_ranges, share_below, slabs, small_batches, split_words
from rulespan.llm.quality_rules import _IS_BLANK, _IS_SYMBOL, repeated_words, stutter_words

STATS = ("log_words", "word_length", "symbols", "marks", "capitals", "digits", "repeats", "line_length", "stutter")


def trigrams(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """The bucket of the byte trigram that starts at each byte; none reaches
    beyond its document, zeros stand in there."""
    code = data.astype(np.uint32)
    ends = offsets[1:][np.diff(offsets) > 0]
    for step in (1, 2):
        later = np.zeros(len(data), np.uint32)
        later[:-step] = data[step:]
        for back in range(1, step + 1):
            later[np.maximum(ends - back, 0)] = 0
        code |= later << np.uint32(8 * step)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_stats(slab: Slab, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each document of a slab."""
    data, n = slab.data, np.maximum(1, slab.counts)
    filled = np.maximum(1.0, sums(~_IS_BLANK[data], offsets))
    lines = 1 + sums(data == 10, offsets)
    columns = (
        np.log1p(slab.counts),
        filled / n,
        sums(_IS_SYMBOL[data], offsets) / filled,
        sums(np.isin(data, np.frombuffer(b"!?.,;:-_=+~^", np.uint8)), offsets) / filled,
        sums((data >= 65) & (data <= 90), offsets) / filled,
        sums((data >= 48) & (data <= 57), offsets) / filled,
        repeated_words(slab) / n,
        np.log1p(n / lines),
        stutter_words(slab) / n,
    )
    return np.stack(columns, 1)


#: Features are whole numbers, this many to the unit, so sums over any number
#: of rows are exact whatever their order.
ONE = 1024


def quality_size(dims: int) -> int:
    return dims + 3 * len(STATS) + 1


def quality_features(text: pa.Array, dims: int) -> np.ndarray:
    """A row for each document: roots of its trigrams' shares of ``dims``
    buckets, STATS brought to about 0 to 1 with their roots and squares, and a
    constant; each between 0 and 4 * ``ONE``."""
    scale = np.array([0.1, 0.1, 1, 1, 1, 1, 1, 0.2, 1])
    out = []
    for _, _, data, offsets in slabs(text):
        slab, size = split_words(data, offsets), np.diff(offsets)
        owner = np.repeat(np.arange(len(size)), size)
        counts = np.bincount(owner * dims + trigrams(data, offsets, dims), minlength=len(size) * dims).reshape(len(size), dims)
        stats = text_stats(slab, offsets) * scale
        stats[:, 1] = np.tanh(stats[:, 1])
        stats = np.clip(stats, 0, 2)
        out.append(np.hstack([np.sqrt(counts / np.maximum(1, size)[:, None]), stats, np.sqrt(stats), stats**2, np.ones((len(size), 1))]))
    return np.rint(np.concatenate(out) * ONE) if out else np.zeros((0, quality_size(dims)))


PREFIXES = (4, 5, 6, 7)


def word_buckets(text: pa.Array, dims: int):
    """Yields (documents, owner, bucket): each bucket of lower-case words, and of
    their first 4 to 7 bytes, once a document.

    Punctuation separates words, so marks stuck to a word do not hide it;
    beginnings catch the inflected and joined forms of a word.
    """
    shift = U64(65 - int(dims).bit_length())
    lowered = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    for _, _, data, offsets in slabs(lowered, SLAB_BYTES):
        slab = split_words(data, offsets, plain=False)
        ranges, owner, size = byte_ranges(slab), slab.owner, slab.end - slab.start
        pairs = [owner * dims + (slab.hash >> shift).astype(np.int64)]
        for n in PREFIXES:
            long = np.flatnonzero(size > n)
            h = ranges(slab.start[long], slab.start[long] + n) ^ U64(0x9E3779B97F4A7C15 * n % (1 << 64))
            pairs.append(owner[long] * dims + (h >> shift).astype(np.int64))
        pair = np.unique(np.concatenate(pairs))
        yield len(offsets) - 1, pair // dims, pair % dims


def training_rows(docs: DataFrame, labels: DataFrame, column: str, keep: Column, rows: int, seed: int) -> DataFrame:
    """About ``rows`` labelled rows of the training fold: doc_id, y.

    Of several labels of one id the least counts; null ids and labels do not.
    The result is at most a small multiple of ``rows`` and may be broadcast.
    """
    small_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(keep)
    return labels.filter(share_below(F.col("doc_id"), rows, labels.count(), seed)).groupBy("doc_id").agg(F.min("y").alias("y"))
