"""Operator 1: near-duplicate classes by Order MinHash and banded alignment.

1. Every text becomes lower-case words (punctuation separates words).  Equal
   word sequences, told by a digest of the words, are exact copies; one row of
   each such text goes on.
2. Order MinHash: k-mers (four words) are labelled with their occurrence, and
   for each of ``entries`` hash functions the ``picks`` smallest labelled
   k-mers are kept in text order; their ordered tuple is a sketch entry.  Two
   texts whose labelled k-mers have Jaccard similarity J meet in some entry
   with about 1 - (1 - J ** picks) ** entries (:func:`recall`).
3. Texts that agree in an entry form a bucket.  Each member is first a
   candidate of the bucket's smallest id: one pair a member.
4. Candidates that lengths and word counts (hashed ones first, then the words
   themselves) cannot rule out are verified by banded alignment of their word
   sequences: a link needs 1 - distance / longer length >= ``similarity``.
5. Links are joined to classes by spreading the least id along them.  In
   buckets that still hold several classes, a random member is a hub for
   ``HUB_ROUNDS`` rounds, which joins large classes by few alignments; then all
   pairs of a bucket that are still in different classes are asked, in blocks
   of members, so no pair of a bucket that would link two classes stays unasked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import BATCH_ROWS, U64, WORD_POWERS, RangeHash, Slab, arrow_batches, mix, per_document, slabs, small_batches, split_words, stage, windows

K = 4
ENTRIES = 48
PICKS = 2
SIMILARITY = 0.8
CELLS = 1 << 20
BAG, FINE_BAG = 64, 1024
BLOCK, BLOCK_PAIRS = 1024, 16
HUB_ROUNDS = 1
_LOW = U64((1 << 24) - 1)
_NONE = U64((1 << 64) - 1)


def normalised(text: pa.Array) -> Iterator[tuple[int, int, Slab]]:
    """Slabs of lower-case words without punctuation, at most 2**24 words each
    unless one document alone has more."""
    lowered = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    for at, to, data, offsets in slabs(lowered):
        yield at, to, split_words(data, offsets, plain=False)


def copy_keys(slab: Slab, text: pa.Array) -> np.ndarray:
    """Two numbers for each document, half a SHA-256 of its words; of its raw
    text where it has no word."""
    size = slab.end - slab.start
    heads = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(heads, size) + step] = slab.data[np.repeat(slab.start, size) + step]
    ends = np.append(heads, len(joined))[slab.first]
    found = [hashlib.sha256(joined[a:b]).digest()[:16] for a, b in zip(ends[:-1], ends[1:])]
    for i in np.flatnonzero(slab.counts == 0).tolist():
        found[i] = hashlib.sha256(b"\0" + (text[i].as_py() or "").encode()).digest()[:16]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def labelled_kmers(slab: Slab, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all k-mers, and hashes that differ between occurrences
    of one k-mer within a document."""
    at = windows(slab, k)
    h = RangeHash(slab.hash, WORD_POWERS)(at, at + k)
    if len(at):
        own = h ^ (slab.owner[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        run = np.flatnonzero(new)
        count = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        h[order] = np.where(count > 0, mix(h[order] + count.astype(U64) * U64(0xD1B54A32D192ED03)), h[order])
    return at, h


def order_sketch(slab: Slab, k: int, entries: int, picks: int) -> np.ndarray:
    """The sketch of each document of a slab: documents x entries, zero where
    a document has no k-mer."""
    at, h = labelled_kmers(slab, k)
    sizes = per_document(slab.first, at)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), entries), U64)
    if not len(some):
        return out
    starts = (np.cumsum(sizes) - sizes)[some]
    bits = max(24, int(len(h)).bit_length())
    low = U64((1 << bits) - 1)
    place = np.arange(len(h), dtype=U64)
    for e in range(entries):
        key = (mix(h ^ U64(0xA0761D6478BD642F * (2 * e + 1) % (1 << 64))) & ~low) | place
        found = np.empty((picks, len(some)), U64)
        for i in range(picks):
            least = np.minimum.reduceat(key, starts)
            found[i] = least
            key[(least & low)[least != _NONE].astype(np.int64)] = _NONE
        where = np.sort(np.where(found == _NONE, low, found & low), axis=0).astype(np.int64)
        entry = np.full(len(some), U64(e + 1))
        for row in where:  # in text order
            entry = mix(entry * U64(0x9FB21C651E98DF25) + np.where(row < len(h), h[np.minimum(row, len(h) - 1)], U64(1)))
        out[some, e] = entry
    return out


def recall(edits: float, k: int = K, entries: int = ENTRIES, picks: int = PICKS) -> float:
    """The chance that two long texts with a share ``edits`` of scattered words
    replaced meet in some entry."""
    same = (1 - edits) ** k
    return 1 - (1 - (same / (2 - same)) ** picks) ** entries


def word_bags(slab: Slab, size: int) -> pa.Array:
    """How many words of each document fall to each of ``size`` (a power of
    two) hash values, a byte each, 255 at most."""
    place = slab.owner * size + (slab.hash >> U64(65 - size.bit_length())).astype(np.int64)
    n = len(slab.counts)
    bags = np.minimum(np.bincount(place, minlength=size * n), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32)), pa.py_buffer(bags)])


def _bags(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def word_gaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of word sequences, how many words one side has more than
    the other, the larger side: no alignment costs less."""
    n = len(a)
    pair = np.concatenate([np.repeat(np.arange(n), [len(x) for x in side]) for side in (a, b)])
    key = pair.astype(U64) << U64(32) | np.concatenate([*a, *b, np.zeros(0, np.uint32)]).astype(U64)
    side = np.ones(len(key), np.int64)
    side[sum(map(len, a)) :] = -1
    order = np.argsort(key, kind="stable")
    key, side = key[order], side[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    more = np.add.reduceat(side, heads) if len(heads) else side
    owner = (key[heads] >> U64(32)).astype(np.int64)
    over, under = (np.bincount(owner, np.maximum(sign * more, 0), minlength=n) for sign in (1, -1))
    return np.maximum(over, under).astype(np.int64)


def edit_limit(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The largest edit distance of a link between texts of n and m words."""
    return np.floor((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)


def could_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """False only for pairs that are no links: an edit takes at most one word
    from what either bag has more of."""
    gap = x.astype(np.int16) - y
    more = np.maximum(gap, 0).sum(1, dtype=np.int64)
    return np.maximum(more, more - gap.sum(1, dtype=np.int64)) <= edit_limit(n, m, similarity)


def band_distances(a: list[np.ndarray], b: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Edit distances of word sequences, or limit + 1 where it is larger.

    All pairs advance together, row by row of their alignments, within a
    diagonal band of half-width ``w``; what costs more than ``w`` is tried
    again in a band four times as wide, up to its limit.
    """
    out = limits + 1
    gap = np.array([abs(len(x) - len(y)) for x, y in zip(a, b)], np.int64)
    todo, w = np.flatnonzero(gap <= limits), 8
    while len(todo):
        reach = np.minimum(limits[todo], w)
        now = todo[gap[todo] <= reach]
        found = np.full(len(a), -1, np.int64)
        now = now[np.argsort([len(a[i]) for i in now], kind="stable")]
        s = 0
        while s < len(now):  # as many pairs together as CELLS allows, of like lengths
            e = min(len(now), s + max(1, CELLS // (len(a[now[s]]) + 2 * w + 64)))
            while e > s + 1 and (e - s) * (len(a[now[e - 1]]) + 2 * w + 64) > CELLS:
                e = s + (e - s) // 2
            group, s = now[s:e], e
            found[group] = _one_band([a[i] for i in group], [b[i] for i in group], np.minimum(limits[group], w), w)
        done = found[todo] >= 0
        out[todo[done]] = found[todo[done]]
        todo = todo[~done & (limits[todo] > w)]
        w *= 4
    return out


def _one_band(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray, w: int) -> np.ndarray:
    """Distances up to ``limit`` (at most w) within the band, else -1."""
    order = np.argsort([len(x) for x in a], kind="stable")
    n, m = np.array([len(a[i]) for i in order]), np.array([len(b[i]) for i in order])
    limit, count = limit[order], len(order)
    if not count:
        return np.zeros(0, np.int64)
    left = np.zeros((count, n[-1]), np.uint32)
    right = np.zeros((count, max(n[-1], m.max()) + 2 * w + 1), np.uint32)
    known = np.zeros(right.shape, bool)
    for r, i in enumerate(order):
        left[r, : n[r]] = a[i]
        right[r, w : w + m[r]] = b[i]
        known[r, w : w + m[r]] = True
    far = np.int32(1 << 28)
    offset = np.arange(-w, w + 1, dtype=np.int32)
    row = np.where(offset >= 0, offset, far)[None, :].repeat(count, 0).astype(np.int32)
    result = np.full(count, -1, np.int64)
    live = np.arange(count)
    empty = n == 0
    result[empty] = np.where(m[empty] <= limit[empty], m[empty], -1)
    live = live[~empty]
    row = row[~empty]
    for i in range(1, int(n[-1]) + 1):
        if not len(live):
            break
        match = (right[live, i - 1 : i + 2 * w] == left[live, i - 1][:, None]) & known[live, i - 1 : i + 2 * w]
        new = row + 1 - match
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= offset
        np.minimum.accumulate(new, axis=1, out=new)
        new += offset
        row = np.minimum(new, far)
        ended = n[live] == i
        if ended.any():
            at = live[ended]
            d = row[ended, (m[at] - n[at] + w)]
            result[at] = np.where(d <= limit[at], d, -1)
        if ended.any() or i % 8 == 0:
            stay = ~ended & (row.min(1) <= limit[live])
            live, row = live[stay], row[stay]
    back = np.empty(count, np.int64)
    back[order] = result
    return back


def word_codes(slab: Slab) -> pa.Array:
    """The words of each document, 32 bits of their hash each."""
    codes = (slab.hash >> U64(32)).astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(slab.counts), [None, pa.py_buffer((4 * slab.first).astype(np.int32)), pa.py_buffer(codes)])


def verify(pairs: DataFrame, traits: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose words in ``traits`` (doc_id, words) align
    well enough.  Joins on ids only; a hot id is one row on its side, so Spark
    can split the other side.  The joins are sort-merge joins at every size, as
    neither ids nor texts have a bound."""
    for end in ("a", "b"):
        pairs = pairs.join(traits.select(F.col("doc_id").alias(end), F.col("words").alias(f"w{end}")).hint("merge"), end)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 128):
                batch = big.slice(s, 128)
                a, b = ([np.frombuffer(x, "<u4") for x in batch.column(c).to_pylist()] for c in ("wa", "wb"))
                longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
                limits = edit_limit(longer, longer, similarity)
                close = word_gaps(a, b) <= limits
                some = np.flatnonzero(close)
                close[some] = band_distances([a[i] for i in some], [b[i] for i in some], limits[some]) <= limits[some]
                ok = pa.array(close)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "wa", "wb").mapInArrow(align, "a long, b long").distinct()


def plausible(pairs: DataFrame, traits: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) without those that ``traits`` (doc_id, n, bag) rule out."""
    for end in ("a", "b"):
        pairs = pairs.join(traits.select(F.col("doc_id").alias(end), F.col("n").alias(f"n{end}"), F.col("bag").alias(f"bag{end}")), end)
    pairs = pairs.filter(F.abs(F.col("na") - F.col("nb")) <= F.floor((1 - similarity) * F.greatest("na", "nb") + 1e-9))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = pa.array(could_link(n, m, _bags(batch.column("baga"), BAG), _bags(batch.column("bagb"), BAG), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "baga", "bagb").mapInArrow(keep, "a long, b long")


def labelled(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels, and the buckets that hold several classes."""
    known = members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    apart = known.groupBy("e", "h").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m")).filter("l0 != l1")
    return known, apart


def pairs_apart(members: DataFrame, labels: DataFrame, traits: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of members of a bucket that are in different classes and
    that ``traits`` do not rule out.

    A bucket's members are dealt to blocks of about ``BLOCK``, and each pair of
    blocks is one row, so no task holds a bucket and only what is left of the
    pairs is written; with ``entries`` in ``traits`` a pair that meets in
    several buckets is written for the first of them only.
    """
    sketched = "entries" in traits.columns
    carried = ["n", "bag", "fine", *(["entries"] if sketched else [])]
    known, apart = labelled(members, labels)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = known.join(apart, ["e", "h"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(traits.select("doc_id", *carried), "doc_id")
    ends = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    groups = rows.select("e", "h", *ends, F.struct("doc_id", "label", "own", *carried).alias("x")).groupBy("e", "h", "i", "j").agg(F.collect_list("x").alias("xs"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("xs")
            sizes = xs.value_lengths().to_numpy().astype(np.int64)
            flat = xs.flatten()
            ids, n, label, own = (flat.field(c).to_numpy() for c in ("doc_id", "n", "label", "own"))
            coarse, fine = _bags(flat.field("bag"), BAG), _bags(flat.field("fine"), FINE_BAG)
            entry = np.repeat(batch.column("e").to_numpy(), sizes)
            sketch = flat.field("entries").flatten().to_numpy().reshape(len(ids), -1) if sketched else None
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            two = np.repeat(batch.column("i").to_numpy() != batch.column("j").to_numpy(), sizes)
            sizes = np.repeat(sizes, sizes)
            ends = np.cumsum(sizes)
            s = 0
            while s < len(ids):  # as many rows together as CELLS pairs allow
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CELLS, "right")))
                k = sizes[s:e]
                p = np.repeat(np.arange(s, e), k)
                q = first[p] + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
                ok = (ids[p] < ids[q]) & (label[p] != label[q]) & ~(two[p] & (own[p] == own[q]))
                p, q = p[ok], q[ok]
                ok = np.abs(n[p] - n[q]) <= edit_limit(n[p], n[q], similarity)
                p, q = p[ok], q[ok]
                for at in range(0, len(p), 1 << 14):
                    a, b = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
                    ok = could_link(n[a], n[b], coarse[a], coarse[b], similarity)
                    a, b = a[ok], b[ok]
                    ok = could_link(n[a], n[b], fine[a], fine[b], similarity)
                    if sketched:
                        ok &= ((sketch[a] == sketch[b]) & (sketch[a] != 0)).argmax(1) == entry[a]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]])], names=["a", "b"])
                s = e

    return groups.select("e", "i", "j", "xs").mapInArrow(cross, "a long, b long").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label) with the least id of each connected component of ``links`` (a, b).

    Each round every vertex is merged into the least vertex around it, and
    that one's own choice, and the edges are drawn anew between what is left;
    settled ones vanish, so the edges of a star are read once.  ``labels``
    carries on from earlier links.  Every round's edges and moves are written
    out, so none recomputes another; the moves are applied at the end.
    """
    edges = links.select("a", "b").filter("a != b")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if labels is None:
        labels = ends.withColumn("label", F.col("id"))
    else:
        edges = _redraw(edges, labels)
        labels = ends.join(labels, "id", "full").select("id", F.coalesce("label", "id").alias("label"))
    edges, moves = stage(edges, "edges"), []
    while not edges.isEmpty():
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = around.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label"))
        beyond = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moves.append(stage(near.join(beyond, "label").select("id", F.col("far").alias("label")), "parents"))
        edges = stage(_redraw(edges, moves[-1]), "edges")
    for moved in moves:
        moved = moved.select(F.col("id").alias("label"), F.col("label").alias("new"))
        labels = labels.join(moved, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    return stage(labels, "labels")


def _redraw(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends, without loops and repeats."""
    for end in ("a", "b"):
        at = labels.select(F.col("id").alias(end), F.col("label").alias("to"))
        edges = edges.join(at, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, entries: int = ENTRIES, picks: int = PICKS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id, n_links, keep.

    class_id is the least doc_id of the class, n_links the number of verified
    links of the row's text to other texts, keep marks one row of each class.
    A null or wordless text is a copy of equal raw texts only.  Rows that
    share an id count as one document, so their classes are one; rows without
    an id are grouped by equal text alone and, if no row with an id has that
    text, get a null class and no keep mark (:func:`dedup` keeps one of them
    for each text).  An empty table gives an
    empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, slab in normalised(batch.column("text")):
                keys = copy_keys(slab, batch.column("text").slice(at, to - at))
                entry = order_sketch(slab, k, entries, picks).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, entry.size + 1, entries, dtype=np.int32), pa.array(entry.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(slab.counts.astype(np.int32)), lists, word_bags(slab, BAG), word_bags(slab, FINE_BAG), word_codes(slab)], names=["doc_id", "k1", "k2", "n", "entries", "bag", "fine", "words"])

    rows = stage(docs.mapInArrow(sketch, "doc_id long, k1 long, k2 long, n int, entries array<long>, bag binary, fine binary, words binary"), "sketches")
    copies = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    # an id that carries several texts joins the classes of them all
    shared = rows.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"]).filter("doc_id != rep")
    several = rows.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("doc_id is not null and lo != hi").select("doc_id")
    twins = shared.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    distinct = rows.filter(f"n >= {k}").join(copies, ["k1", "k2"]).filter("doc_id = rep")
    traits = distinct.select("doc_id", "n", "bag", "fine", "words", "entries")
    buckets = distinct.select("doc_id", F.posexplode("entries").alias("e", "h")).filter("h != 0")
    ends = buckets.groupBy("e", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("e", "h", "lo")
    members = stage(buckets.join(ends, ["e", "h"]), "members")
    traits = stage(traits.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "traits")

    def ordered(hubs: DataFrame) -> DataFrame:
        return hubs.filter("hub != doc_id").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()

    asked = ordered(members.select("doc_id", F.col("lo").alias("hub")))
    pairs = stage(plausible(asked, traits, similarity), "pairs")
    links = stage(verify(pairs, traits, similarity), "links")
    labels = components(links.union(twins))
    members = members.select("e", "h", "doc_id")
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:  # a random member of each bucket with several classes is asked by those of other classes
            known, apart = labelled(members, labels)
            known = known.join(apart.select("e", "h"), ["e", "h"])
            hubs = known.groupBy("e", "h").agg(F.min_by(F.struct("doc_id", "label"), F.xxhash64("doc_id", "e", F.lit(turn))).alias("top"))
            more = plausible(ordered(known.join(hubs, ["e", "h"]).filter("label != top.label").select("doc_id", F.col("top.doc_id").alias("hub"))), traits, similarity)
        else:
            more = pairs_apart(members, labels, traits, similarity)
        with arrow_batches(docs.sparkSession, BLOCK_PAIRS if turn == HUB_ROUNDS else BATCH_ROWS):  # a pair of blocks is one row
            more = stage(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        found = stage(verify(more, traits, similarity), "links")
        pairs = pairs.union(more)
        if not found.isEmpty():
            links, labels = links.union(found), components(found, labels)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    marked = copies.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").join(degree, "rep", "left")
    marked = marked.select("k1", "k2", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("doc_id", "k1", "k2").join(marked, ["k1", "k2"])
    return out.select("doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("keep"), F.col("k1"), F.col("k2"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least id.

    Of rows that repeat this id one stays; rows without an id stay once a text
    unless a row with an id has the same text.
    """
    marks = near_duplicates(docs, **options)
    first = marks.filter("keep").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    orphans = marks.filter("class_id is null").select("k1", "k2").distinct()
    if orphans.isEmpty():
        return kept
    lone = docs.filter("doc_id is null").dropDuplicates(["text"])
    known = docs.filter("doc_id is not null").select("text").distinct()
    return kept.unionByName(lone.join(known, lone["text"].eqNullSafe(known["text"]), "left_anti"))
