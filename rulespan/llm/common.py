"""What the text operators share: staged tables and vectorised word hashing.

Words are maximal runs of anything but the six ASCII blanks (space, tab, line
feed, vertical tab, form feed, carriage return).  They are found and hashed
for a slab of whole documents at once in numpy, so no Python object is made
for a word and memory follows the slab (or the one longest document).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLAB_BYTES = 1 << 19
BATCH_ROWS = 1000
U64 = np.uint64
# Fixed odd multipliers; every executor must agree on them.
BYTE_BASE = U64(0x9E3779B97F4A7C13)
WORD_BASE = U64(0xC2B2AE3D27D4EB4B)
WORD_BASE_2 = U64(0xD6E8FEB86659FD93)
BLANKS = b" \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only a local session may go without that setting; it gets a folder of its
    own under the temporary directory.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rulespan-")
        if "://" not in base:
            base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rulespan-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table", cluster_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage like a reliable checkpoint, but column-wise and
    compressed, and later readers load only the columns they name.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at ``BATCH_ROWS`` rows or fewer: texts
    have no bound, and a task holds a batch in the JVM and in Python."""
    if not 0 < int(spark.conf.get(ARROW_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the jobs that run inside."""
    before = spark.conf.get(ARROW_ROWS, "10000")
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def plain_names(table: DataFrame) -> tuple[list[str], StructType]:
    """Names for the columns of ``table`` that hold no dot, and their schema:
    Python tasks look their columns up by name."""
    names = [f"c{i}" for i in range(len(table.columns))]
    return names, StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, table.schema.fields)])


def packed(table: DataFrame) -> Column:
    """All columns of ``table`` as one, ``row``, so that none meets a helper's."""
    return F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("row")


def unpacked(table: DataFrame) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in table.columns]


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def share_below(key: Column, rows: int, of: int, seed: int) -> Column:
    """Keeps about ``rows`` of ``of`` rows, the same ones on every run."""
    share = min(1.0, rows / max(1, of))
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, self.base)]))
                self.down = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


class RangeHash:
    """Hashes of arbitrary ranges of a sequence from one running sum."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


class Places:
    """A fixed random factor for each byte position of a word, grown on demand."""

    def __init__(self, seed: int):
        self.seed, self.factors = U64(seed), np.zeros(0, U64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.factors) < n:
            at = np.arange(1, max(n, 2 * len(self.factors), 1 << 12) + 1, dtype=U64)
            self.factors = mix(mix(at * U64(0xD1342543DE82EF95)) + self.seed)
        return self.factors


_PLACES, _PLACES_2 = Places(0xAEF17502108EF2D9), Places(0x5A2D63F29B8C1E47)
_BYTE_POWERS, WORD_POWERS, WORD_POWERS_2 = Powers(BYTE_BASE), Powers(WORD_BASE), Powers(WORD_BASE_2)
_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


def _separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(BLANKS + extra, np.uint8)] = True
    return table


_BLANK, _BLANK_OR_PUNCTUATION = _separators(), _separators(PUNCTUATION)


@dataclass
class Slab:
    """The words of several whole documents, one after another.

    ``first[i]:first[i + 1]`` are the words of document i; ``start`` and
    ``end`` are byte positions in ``data``; ``hash`` has one value a word.
    Equal hashes of a slab's words are checked by :meth:`equal`, words of
    different tables meet by ``hash`` and ``hash2`` together, which have
    factors of their own, or by a digest.
    """

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hash2(self) -> np.ndarray:
        """A second hash of each word, with other factors."""
        return hash_words(self.data, self.start, self.end, _PLACES_2)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words numbered ``a`` and ``b`` have the same bytes."""
        size = self.end[a] - self.start[a]
        same = size == self.end[b] - self.start[b]
        some = np.flatnonzero(same)
        if len(some):
            n = size[some]
            heads = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(heads, n)
            match = self.data[np.repeat(self.start[a[some]], n) + step] == self.data[np.repeat(self.start[b[some]], n) + step]
            same[some] = np.logical_and.reduceat(match, heads)
        return same


def split_words(data: np.ndarray, offsets: np.ndarray, plain: bool = True) -> Slab:
    """Find and hash the words of documents at ``data[offsets[i]:offsets[i+1]]``.

    With ``plain`` off, ASCII punctuation separates words too.
    """
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~(_BLANK if plain else _BLANK_OR_PUNCTUATION)[data]
    begins = (inside[1:-1] == 1) & (inside[:-2] == 0)
    ends = (inside[1:-1] == 1) & (inside[2:] == 0)
    cut = offsets[1:-1]
    if len(cut):  # a document's end is a word's end
        at = cut[cut < n]
        begins[at] |= inside[at + 1] == 1
        at = cut[cut > 0] - 1
        ends[at] |= inside[at + 1] == 1
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Slab(data, np.searchsorted(start, offsets), start, end, hash_words(data, start, end))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, places: Places = _PLACES) -> np.ndarray:
    """A hash for each word: its bytes' codes times a random factor for their
    place, so no pattern within a word makes words collide."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    heads = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(heads, size)
    codes = _BYTE_CODES[data[np.repeat(start, size) + place]]
    codes *= places(int(size.max()))[place]
    return mix(np.add.reduceat(codes, heads) + size.astype(U64))


def byte_ranges(slab: Slab) -> RangeHash:
    """Hashes of byte ranges of a slab."""
    return RangeHash(_BYTE_CODES[slab.data], _BYTE_POWERS)


def slabs(text: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole documents of about ``limit`` bytes.

    Yields (from row, to row, bytes, offsets); a null is an empty document.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    _, places, payload = text.buffers()
    offsets = np.frombuffer(places, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_slabs(text: pa.Array, plain: bool = True, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, Slab]]:
    for at, to, data, offsets in slabs(text, limit):
        yield at, to, split_words(data, offsets, plain)


def windows(slab: Slab, k: int) -> np.ndarray:
    """First words of all runs of k words that lie within one document."""
    last = np.repeat(slab.first[1:], slab.counts)
    at = np.arange(len(slab.hash))
    return at[at + k <= last]


def per_document(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the positions ``at`` (ascending) fall to each document."""
    return np.diff(np.searchsorted(at, first))


def numbered(rows: DataFrame, by: list[str], order: Column, weight: str | None = None, salts: int = 1024) -> DataFrame:
    """Number the rows of each group ``by`` from 0 in a fixed, seeded order.

    Adds ``rank``; a row with a ``weight`` stands for that many, of which
    ``rank`` is the first.  A group is cut into ``salts`` parts by the 64-bit
    hash ``order``; the parts' sizes are counted first, so a part starts its
    numbers where the one before ended and no task sorts a whole group.
    Rows with equal hashes are interchangeable.
    """
    many = F.col(weight) if weight else F.lit(1).cast("long")
    rows = rows.withColumn("_order", order).withColumn("_part", F.pmod("_order", F.lit(salts)))
    keys = [*by, "_part"]
    parts = rows.groupBy(*keys).agg(F.sum(many).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(parts.select(*keys, before.alias("_before")), keys)
    place = F.sum(many).over(Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)) - many
    return rows.withColumn("rank", F.col("_before") + place).drop("_order", "_part", "_before")
