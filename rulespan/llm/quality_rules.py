"""Operator 10: quality rules as a short-circuit cascade.

A pilot run over a drawn sample times every rule and counts what it rejects;
the rules then run in falling order of rejections per cost, and each computes
what it needs only for the documents that the ones before it let pass.  The
order changes the work, never the verdict: a document is kept if no rule
rejects.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import BLANKS, WORD_POWERS, RangeHash, Slab, share_below, small_batches, windows, word_slabs

REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
PILOT_ROWS = 400
PILOT_TURNS = 3

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[np.frombuffer(BLANKS, np.uint8)] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _same_windows(slab: Slab, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each of ``a`` equal those from each of ``b``.

    Windows follow on one another, so each pair of words is compared once.
    """
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 15):
        left, right = (x[s : s + (1 << 15), None] + np.arange(k) for x in (a, b))
        pairs, which = np.unique(left.ravel() * (len(slab.hash) + 1) + right.ravel(), return_inverse=True)
        same = slab.equal(pairs // (len(slab.hash) + 1), pairs % (len(slab.hash) + 1))
        out[s : s + (1 << 15)] = same[which].reshape(left.shape).all(1)
    return out


def repeated_words(slab: Slab, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, words covered by a k-word window found twice or more in it.

    Windows with equal hashes are compared word by word.
    """
    at = windows(slab, k)
    covered = np.zeros(len(slab.hash) + 1, np.int64)
    if len(at):
        owner = slab.owner[at]
        key = RangeHash(slab.hash, WORD_POWERS)(at, at + k) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[order][1:] == key[order][:-1])
        a, b = order[twin], order[twin + 1]
        again = np.zeros(len(at), bool)
        if ((owner[a] == owner[b]) & _same_windows(slab, at[a], at[b], k)).all():
            again[a] = again[b] = True
        else:  # unlike windows with one hash: those in question are told apart by their bytes
            found: dict[tuple, list[int]] = {}
            for i in np.unique(np.concatenate([a, b])).tolist():
                words = range(at[i], at[i] + k)
                found.setdefault((owner[i], *(slab.data[slab.start[w] : slab.end[w]].tobytes() for w in words)), []).append(i)
            again[[i for group in found.values() if len(group) > 1 for i in group]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + k, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, slab.first)


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS.decode()):
            seen.add(line)
    return n


@dataclass(frozen=True)
class View:
    """The documents of a slab: their words, bytes and texts."""

    slab: Slab
    offsets: np.ndarray
    text: pa.Array

    def count(self, marks: Callable[[np.ndarray], np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Bytes that ``marks`` marks in each of the documents ``rows``."""
        index, edges = _picked(self.offsets, rows)
        return _sums(marks(self.slab.data if index is None else self.slab.data[index]), edges)


def _picked(edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Positions of the parts ``rows`` of a cut array (None: all of it) and their new edges."""
    if len(rows) == len(edges) - 1:
        return None, edges
    size = np.diff(edges)[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(edges[:-1][rows], size) + np.arange(new[-1]) - np.repeat(new[:-1], size), new


def views(text: pa.Array) -> Iterator[View]:
    for at, to, slab in word_slabs(text):
        offsets = np.zeros(to - at + 1, np.int64)
        np.cumsum(pc.binary_length(pc.fill_null(text[at:to], "")).to_numpy(zero_copy_only=False), out=offsets[1:])
        yield View(slab, offsets, text[at:to])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(view: View) -> dict[str, np.ndarray]:
    """The counted columns of every document; they are returned, so all are needed."""
    data = view.slab.data
    lines = (duplicate_lines(x) if x else 0 for x in view.text.to_pylist())
    chars, symbols = _sums(((data & 0xC0) != 0x80) & ~_IS_BLANK[data], view.offsets), _sums(_IS_SYMBOL[data], view.offsets)
    found = (view.slab.counts, chars, symbols, np.fromiter(lines, np.int64, len(view.text)), repeated_words(view.slab))
    return {k: v.astype(np.int64) for k, v in zip(COUNTS, found)}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def stutter_words(slab: Slab, rows: np.ndarray | None = None) -> np.ndarray:
    """Per document (of ``rows``, or all), words equal to the word before them."""
    index, edges = _picked(slab.first, np.arange(len(slab.counts)) if rows is None else rows)
    word = np.arange(len(slab.hash)) if index is None else index
    same = np.zeros(len(word), bool)
    same[1:] = (slab.hash[word[1:]] == slab.hash[word[:-1]]) & (word[1:] == word[:-1] + 1)
    heads = edges[:-1]
    same[heads[heads < len(same)]] = False
    some = np.flatnonzero(same)
    same[some] = slab.equal(word[some], word[some] - 1)
    return _sums(same, edges)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the counts of the documents still in play, all
    documents of the slab, and which of them are in play."""

    name: str
    rejects: Callable[[dict[str, np.ndarray], View, np.ndarray], np.ndarray]


def _is_letter(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    return ((low >= 97) & (low <= 122) & (data < 128)) | (data >= 0xC0)


def _line_fragments(counts: dict[str, np.ndarray], view: View, rows: np.ndarray) -> np.ndarray:
    """More than nine lines in ten are fragments under three words, over ten lines."""
    bad = []
    for x in view.text.take(pa.array(rows)).to_pylist():
        sizes = [len(s.split(None, 3)) for s in (x or "").encode().split(b"\n")]
        short, filled = sum(0 < n < 3 for n in sizes), sum(n > 0 for n in sizes)
        bad.append(filled > 10 and 10 * short > 9 * filled)
    return np.array(bad, bool)


RULES = (
    Rule("symbols", lambda c, v, rows: 20 * c["n_symbols"] > c["word_chars"]),
    Rule("long_words", lambda c, v, rows: c["word_chars"] > 40 * c["n_words"]),
    Rule("short_words", lambda c, v, rows: c["word_chars"] < 2 * c["n_words"]),
    Rule("few_letters", lambda c, v, rows: 2 * v.count(_is_letter, rows) < c["word_chars"]),
    Rule("line_fragments", _line_fragments),
    Rule("stutter", lambda c, v, rows: 10 * stutter_words(v.slab, rows) > 3 * c["n_words"]),
)


def pilot(text: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """Seconds of processor time spent and documents rejected by each rule among
    those that pass the base rule; the quickest of a few turns counts."""
    spent, rejected = dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0)
    for view in views(text):
        counts = base_counts(view)
        rows = np.flatnonzero(~base_failed(counts))
        counts = {k: v[rows] for k, v in counts.items()}
        for rule in rules if len(rows) else ():
            turns = []
            for _ in range(PILOT_TURNS):
                began = time.thread_time()
                bad = rule.rejects(counts, view, rows)
                turns.append(time.thread_time() - began)
            spent[rule.name] += min(turns)
            rejected[rule.name] += int(np.count_nonzero(bad))
    return [{"rule": r.name, "seconds": spent[r.name], "rejected": rejected[r.name]} for r in rules]


def order_rules(report: list[dict], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by falling rejections per cost, of those that reject nothing the
    cheapest first; names break ties."""
    known = {r["rule"]: (-r["rejected"] / max(r["seconds"], 1e-9), r["seconds"]) for r in report}
    return tuple(sorted(rules, key=lambda r: (*known.get(r.name, (0.0, 0.0)), r.name)))


def cascade(counts: dict[str, np.ndarray], view: View, alive: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which documents no rule rejects; a rule sees only what is still alive."""
    alive = alive.copy()
    for rule in rules:
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        bad = rule.rejects({k: v[rows] for k, v in counts.items()}, view, rows)
        alive[rows[bad]] = False
    return alive


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, pilot_rows: int = PILOT_ROWS) -> DataFrame:
    """Count, judge and return every row of ``docs`` (doc_id, text).

    One narrow pass: no shuffle, each document is read once and whole.  The
    pilot runs in tasks over about ``pilot_rows`` whole texts, drawn from all
    rows by a hash of id and text; the driver gets two numbers for each rule.
    A null text counts as empty, so it fails the base rule; rows with equal or
    null ids are judged one by one; an empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = docs.filter(share_below(F.xxhash64("doc_id", "text"), pilot_rows, docs.count(), 31)).select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(pilot(batch.column("text"), rules), pa.schema({"rule": pa.string(), "seconds": pa.float64(), "rejected": pa.int64()}))

    report = sample.mapInArrow(measure, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    ordered = order_rules([r.asDict() for r in report.collect()], rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for view in views(batch.column("text")):
                counts = base_counts(view)
                failed = base_failed(counts)
                kept = cascade(counts, view, ~failed, ordered)
                ids = batch.column("doc_id").slice(at, len(failed))
                at += len(failed)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(counts[k]) for k in COUNTS), pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
