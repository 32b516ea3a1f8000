"""Operator 5: exact substring removal by seed and extend.

A window is ``length`` consecutive words.  Winnowing picks, for every window,
the least hash of the seed-word runs inside it (the rightmost of equals), so
two places with one window agree on its anchor and on where it lies.  The
windows of one anchor are consecutive; together they span a *stretch*: the
anchor with an arm of words to either side.

1. Seeds: stretches are joined on their anchor's hash; an anchor that occurs
   once settles all its windows as unique.  Equal stretches are then counted,
   so a passage that many documents share is one row from there on.
2. Extend: a stretch that occurs more than once matches over both of its whole
   arms.  Where an anchor has several stretches, each is extended by itself:
   from the anchor ``o`` words to the left and the rest of ``length`` to the
   right, for every ``o`` that its arms allow; what meets another stretch at
   equal words is a match that far to either side.
3. Matches of a document that overlap or adjoin merge to maximal repeats.

Words of different documents are compared by 128 bits: the anchor's hash and
the stretch's, or two of a window, each over word hashes with factors of
their own.  Windows are judged on the input alone.
Copies of a stretch never meet in pairs; counts are partial before each
shuffle, and tables are written before they are joined to a count, so that
Spark can split a hot key's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import U64, WORD_POWERS, WORD_POWERS_2, RangeHash, Slab, mix, packed, plain_names, small_batches, stage, unpacked, windows, word_slabs

LENGTH = 35
SEED = 8


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that tell rows apart unless id and text are equal."""
    did = doc_id.cast("long")
    return [F.coalesce(did, F.lit(0).cast("long")).alias("did"), F.xxhash64(did.isNull(), text).alias("tid")]


def anchors(slab: Slab, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of a slab, the first word of each one's
    anchor and that anchor's hash."""
    at = windows(slab, length)
    grams = np.arange(len(slab.hash) - seed + 1)
    seeds = mix(RangeHash(slab.hash, WORD_POWERS)(grams, grams + seed) ^ U64(0x5851F42D4C957F2D))
    width = length - seed + 1
    # the rightmost least seed of each window, slab-wide; only windows within a document are used
    best, value = grams[: len(grams) - width + 1].copy(), seeds[: len(grams) - width + 1].copy()
    for step in range(1, width):
        other = seeds[step : len(grams) - width + 1 + step]
        better = other <= value
        value = np.where(better, other, value)
        best[better] = np.flatnonzero(better) + step
    return at, best[at], value[at]


def _emit(batch: pa.RecordBatch, at: int, doc: np.ndarray, names: tuple[str, ...]) -> list[pa.Array]:
    rows = pa.array(doc + at)
    return [batch.column(c).take(rows) for c in names]


def stretches(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """All stretches of ``docs`` (did, tid, text): did, tid, seed (the anchor's
    hash), h (that of all their words, by the second word hash), lo (first word)
    and n (windows)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, slab in word_slabs(batch.column("text")):
                if slab.counts.max(initial=0) < length:
                    continue
                window, anchor, value = anchors(slab, length, seed)
                owner = slab.owner[window]
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
                n = np.diff(np.append(new, len(window)))
                first, doc = window[new], owner[new]
                arrays = [pa.array(value[new].astype(np.int64)), pa.array(RangeHash(slab.hash2, WORD_POWERS_2)(first, first + n - 1 + length).astype(np.int64)), pa.array((first - slab.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*_emit(batch, at, doc, ("did", "tid")), *arrays], names=["did", "tid", "seed", "h", "lo", "n"])

    return docs.mapInArrow(find, "did long, tid long, seed long, h long, lo int, n int")


def extended(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The windows of the stretches ``asked`` (did, tid, lo, n, done) of ``docs``:
    did, tid, w and v (by both word hashes), lo, done.  A text is fetched
    once however many stretches it has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
            flat = asked.flatten()
            lo, n, done = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "done"))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for at, to, slab in word_slabs(batch.column("text")):
                part = slice(edges[at], edges[to])
                count = n[part].astype(np.int64)
                doc = np.repeat(np.repeat(np.arange(to - at), sizes[at:to]), count)
                start = np.repeat(lo[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = start + slab.first[doc]
                hashed = (RangeHash(slab.hash, WORD_POWERS)(first, first + length), RangeHash(slab.hash2, WORD_POWERS_2)(first, first + length))
                arrays = [*(pa.array(x.astype(np.int64)) for x in hashed), pa.array(start.astype(np.int32)), pa.array(np.repeat(done[part], count))]
                yield pa.RecordBatch.from_arrays([*_emit(batch, at, doc, ("did", "tid")), *arrays], names=["did", "tid", "w", "v", "lo", "done"])

    each = asked.groupBy("did", "tid").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "done"))).alias("asked"))
    texts = docs.join(each, ["did", "tid"]).select("did", "tid", "text", "asked")
    return texts.mapInArrow(cut, "did long, tid long, w long, v long, lo int, done boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(did, tid, spans) for rows of ``docs`` (did, tid, text) with a repeat:
    spans are [first word, windows] of overlapping runs of repeated windows."""
    small_batches(docs.sparkSession)
    placed = stage(stretches(docs, length, seed), "stretches")
    seeds = stage(placed.groupBy("seed").agg(F.count("*").alias("c")).filter("c > 1").select("seed"), "seeds")
    met = stage(placed.join(seeds, "seed"), "met")
    # any of the equal stretches stands for all of them: their words are the same
    kinds = stage(met.groupBy("seed", "h").agg(F.count("*").alias("c"), *(F.first(k).alias(k) for k in ("did", "tid", "lo", "n"))), "kinds")
    repeats = stage(kinds.filter("c > 1").select("seed", "h"), "repeats")
    whole = met.join(repeats, ["seed", "h"]).select("did", "tid", "lo", "n")

    mixed = stage(kinds.groupBy("seed").agg(F.count("*").alias("k")).filter("k > 1").select("seed"), "mixed")
    asked = kinds.join(mixed, "seed").select("did", "tid", "lo", "n", (F.col("c") > 1).alias("done"))
    pieces = stage(extended(docs, asked, length), "windows")
    again = stage(pieces.groupBy("w", "v").agg(F.count("*").alias("c")).filter("c > 1").select("w", "v"), "again")
    parts = pieces.filter("not done").join(again, ["w", "v"]).select("did", "tid", "lo", F.lit(1).alias("n"))
    return whole.union(parts).groupBy("did", "tid").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with what stays of its text.

    Returns doc_id, n_words, n_removed, kept_sha256, spans (maximal repeats as
    [first word, words]) and kept (the kept words joined by one space).  All
    occurrences of a repeat go, the first included.  A null text is an empty
    one; equal rows are repeats of each other; rows are told apart by id and
    text, so missing or repeated ids do no harm; an empty table gives an empty
    result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(docs.select("did", "tid", "text"), length, seed)
    joined = docs.join(spans, ["did", "tid"], "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, words, removed, digest, runs = [], [], [], [], []
            lists = batch.column("spans")
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False), 0).astype(int)
            flat = lists.drop_null().flatten()
            lo, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n"))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = text.encode().split()
                a, b = edges[i], edges[i + 1]
                spans = _merge(lo[a:b], n[a:b] - 1 + length)
                stay, at = [], 0
                for s, e in spans:
                    stay += found[at:s]
                    at = e
                stay += found[at:]
                whole = b" ".join(stay)
                kept.append(whole.decode())
                words.append(len(found))
                removed.append(len(found) - len(stay))
                digest.append(hashlib.sha256(whole).hexdigest())
                runs.append([[s, e - s] for s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string")


def strip_documents(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the text and n_chars that stay; documents that lose their
    last word go.  A text that loses nothing is left as it was.  Columns of
    any name pass through."""
    held = docs.select(*row_keys(F.col("doc_id"), F.col("text")), packed(docs))
    spans = repeated_spans(held.select("did", "tid", F.coalesce(F.col("row").getField("text").cast("string"), F.lit("")).alias("text")), length, seed)
    joined = held.join(spans, ["did", "tid"], "left").select(*unpacked(docs), "spans")
    names, (plain, schema) = docs.columns, plain_names(docs)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = batch.column(names.index("text")).to_pylist(), []
            for i, found in enumerate(batch.column(len(names)).to_pylist()):
                if found:
                    words, lo = texts[i].encode().split(), np.array([x["lo"] for x in found])
                    for s, e in reversed(_merge(lo, np.array([x["n"] for x in found]) - 1 + length)):
                        del words[s:e]
                    texts[i] = b" ".join(words).decode()
                stay.append(not found or bool(texts[i]))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=plain).filter(pa.array(stay, pa.bool_()))

    out = joined.toDF(*plain, "spans").mapInArrow(strip, schema).toDF(*names)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names))


def _merge(lo: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of overlapping or adjoining spans."""
    order = np.argsort(lo, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(lo[order].tolist(), (lo + size)[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
