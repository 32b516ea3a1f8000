"""Operator 9: best-fit packing by exact-complement hashing.

Documents are tokenised once, in tasks; what is shuffled is a slim row for
each piece.  The packing plan is made from the counts of the at most
``capacity`` piece lengths: from the longest down, a combination of one, two or
three lengths that fills a gap exactly is consumed while the counts last, and
what no combination takes is packed best fit.  Pieces then find their place by
their number within their length, which a salted count gives without sorting a
whole length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import numbered, small_batches, stage

CAPACITY = 1024
END_ID = 2
CACHE = 600_000
# Runs of blanks from this length on are tokenised without the pattern, whose
# look-ahead needs stack for each blank.
LONG_RUN = 1000
SLICE = 1 << 20
# What the pattern takes for a blank, and those of one byte.
UNICODE_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_BLANK = b"\t\n\x0b\x0c\r "
# Fixed value: the pre-tokenising pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokenizer(dict):
    """Token ids (packed little-endian 32-bit) of texts, through a cache.

    A text falls into chunks that start at a blank followed by a visible
    character; the vocabulary's pattern never joins across such a place, so
    chunks can be tokenised alone and remembered.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], file.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by more than their text are not read")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if added else None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if all(c in letters for c in word)}
        special = {w for w in vocab if w.startswith("<|")}
        for w in special:
            ranks.pop(w.encode(), None)
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_runs = re.compile(f"[{UNICODE_BLANK}]{{{LONG_RUN},}}").finditer
        blanks = {w: i for w, i in ranks.items() if w and not w.strip(ASCII_BLANK)}
        self.single, self.double = np.zeros(256, "<u4"), np.zeros(256, "<u4")
        for w, i in blanks.items():
            (self.single if len(w) == 1 else self.double)[w[0]] = i
        self.by_rule = set(ASCII_BLANK) <= {w[0] for w in blanks if len(w) == 1} and all(len(w) == 1 or w in (w[:1] * 2,) for w in blanks)
        self.uneven = re.compile(r" (?:\s|\Z)").search
        self.parts = re.compile(r" (?=\S)").split

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.encode(" " + chunk)
        if len(chunk) < LONG_RUN:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text without added tokens.  All but the last blank of a
        long run is one word of the pattern, the last one goes with what
        follows; at the end of a text the whole run is one."""
        if len(text) < LONG_RUN:
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        out, at = [], 0
        for run in self.long_runs(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [array("I", self.encoding.encode_ordinary(text[at : run.start()])).tobytes(), *self.blank_run(text[run.start() : end])]
            at = end
        return b"".join([*out, array("I", self.encoding.encode_ordinary(text[at:])).tobytes()])

    def blank_run(self, run: str) -> Iterator[bytes]:
        """The ids of one word of blanks.  Where the vocabulary joins blanks to
        doubles only, every stretch of one blank is doubles from its start and
        a single if it is odd; it may be cut at any even place."""
        data = run.encode()
        if not self.by_rule or data.strip(ASCII_BLANK):
            yield array("I", self.encoding._encode_single_piece(data)).tobytes()
            return
        x, at = np.frombuffer(data, np.uint8), 0
        while at < len(x):
            part = x[at : at + SLICE]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            if at + len(part) < len(x) and (len(part) - heads[-1]) % 2:  # its last stretch may go on
                part = part[:-1]
                heads = heads[heads < len(part)]
            at += len(part)
            odd = (np.arange(len(part)) - np.repeat(heads, np.diff(np.r_[heads, len(part)]))) % 2 == 1
            joined = np.r_[odd[1:], False] & (self.double[part] > 0)
            ids = np.where(joined, self.double[part], self.single[part])
            yield ids[~(odd & (self.double[part] > 0))].tobytes()

    def ids(self, text: str) -> bytes:
        head, *rest = self.parts(text) if self.uneven(text) else text.split(" ")
        return self.encode(head) + b"".join(map(self.__getitem__, rest))

    def document_ids(self, text: str) -> bytes:
        """As the library at its default settings: the file's added tokens
        are found in the text first, what lies between them is tokenised."""
        if self.at_added is None:
            return self.ids(text)
        first, *rest = self.at_added(text)
        return self.ids(first) + b"".join(self.added[x] if i % 2 == 0 else self.ids(x) for i, x in enumerate(rest))


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One for each path and worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def _fits(free: np.ndarray, parts: tuple[int, ...]) -> int:
    return min(int(free[p]) // n for p, n in Counter(parts).items())


def _pair(free: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two free lengths that sum to ``total``, as even as can be: short pieces
    are what the rest will need most."""
    a = np.arange((total + 1) // 2, total)
    ok = (free[a] > 0) & (free[total - a] > 0) & ((2 * a != total) | (free[a] > 1))
    hit = a[ok]
    return (int(hit[0]), total - int(hit[0])) if len(hit) else None


def _complement(free: np.ndarray, length: int, gaps: np.ndarray) -> tuple[int, tuple[int, ...]] | None:
    """The least of ``gaps`` (ascending, all over ``length``) that ``length`` and
    one more free piece fill exactly, or else with two more, and those parts.

    Lengths over ``length`` are used up, so the parts found are shorter ones.
    """
    free[length] -= 1
    try:
        single = gaps[free[gaps - length] > 0]
        if len(single):
            return int(single[0]), (length, int(single[0]) - length)
        for gap in gaps.tolist():
            if pair := _pair(free, gap - length):
                return gap, (length, *pair)
        return None
    finally:
        free[length] += 1


def plan_packing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for ``counts[length]``
    pieces; the capacity is the largest index.

    Lengths are dealt from the longest down.  Each first looks for a gap that
    it fills exactly, alone, with one or with two shorter pieces, as often as
    the counts allow; only where no combination fits is it placed best fit, in
    the least gap that holds it, and only where none does in a new sequence.
    Lengths, not pieces, are visited, so the work has a bound.
    """
    free, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by gap
    open_gaps = np.zeros(capacity + 1, np.int64)

    def fill(gap: int, added: tuple[int, ...], n: int) -> None:
        """Put ``added`` in ``n`` sequences that have this gap."""
        for p in added:
            free[p] -= n
        rest = gap - sum(added)
        open_gaps[gap] -= n
        open_gaps[rest] += n
        while n:
            parts, many = bins[gap].pop()
            used = min(n, many)
            if many > used:
                bins[gap].append((parts, many - used))
            bins[rest].append(((*parts, *added), used))
            n -= used

    for length in range(capacity, 0, -1):
        while free[length] > 0:
            if open_gaps[length] > 0:
                fill(length, (length,), min(int(open_gaps[length]), int(free[length])))
                continue
            gaps = np.flatnonzero(open_gaps[length + 1 :]) + length + 1
            if len(gaps) and (found := _complement(free, length, gaps)):
                gap, parts = found
                fill(gap, parts, min(int(open_gaps[gap]), _fits(free, parts)))
            elif len(gaps):
                fill(int(gaps[0]), (length,), min(int(open_gaps[gaps[0]]), int(free[length])))
            else:  # new sequences; one that takes copies is filled before the next opens
                n = max(1, int(free[length]) // (capacity // length))
                bins[capacity - length].append(((length,), n))
                open_gaps[capacity - length] += n
                free[length] -= n
    return [x for gap in bins for x in gap]


def places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first number), that number, first sequence, offset."""
    used: Counter = Counter()
    rows, base = [], 0
    for parts, n in plan:
        at = 0
        for p in parts:
            rows.append((p << 40 | used[p], used[p], base, at))
            used[p] += n
            at += p
        base += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, key, piece, start, length, ids_crc32) of every document."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).document_ids
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(encode(text or "") + end)
                total = len(ids) // 4
                a, k = 0, 0
                b = total % capacity or min(total, capacity)
                while a < total:
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, b, k = b, b + capacity, k + 1
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.mapInArrow(cut, "doc_id long, key long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A
    null text is an empty one and still has its end id; equal rows are packed
    each; documents over ``capacity`` tokens are cut from their end, so only
    the first piece may be shorter; an empty table gives an empty result.  A
    text of any length, long runs of blanks included, is tokenised whole in
    the task that holds it, at four bytes an id; pieces of equal length are
    dealt by a hash of their document and number, so ties are settled alike on
    every run.  Other columns, whatever their names, are not read.
    The driver sees at most ``capacity`` counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stage(pieces(docs, tokenizer_path or default_tokenizer(), capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    key, first, base, at = places(plan_packing(counts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(key, length << 40 | rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(base[slot] + rank - first[slot]), pa.array(at[slot])], names=[*names, "sequence_id", "offset"])

    ranked = numbered(made, ["length"], F.xxhash64("key", "piece"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
