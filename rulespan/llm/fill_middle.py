"""Operator 12: fill-in-middle transformation of documents.

A text is cut into units (lines, by default).  The units' end offsets go into
one compact array, so a document of any length costs eight bytes a unit, and
prefix, middle and suffix are two lookups and three slices.  Where to cut and
which form to write are drawn from a digest of the document's id: every run,
partitioning and retry gives the same rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rulespan.llm.common import small_batches

UNIT = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100
SPM = 50


def draws(doc_id: str, seed: int) -> list[int]:
    """Four 32-bit numbers drawn from a document's id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    return array("q", (m.end() for m in unit.finditer(text)))


def arrange(form: str, prefix: str, middle: str, suffix: str, marks: Sequence[str]) -> str:
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restore(output: str, form: str, marks: Sequence[str] = MARKS) -> str:
    """The text that ``output`` was made of."""
    p, s, m = marks
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    turn = output.index(second, len(first))
    last = output.index(m, turn + len(second))
    one, two, middle = output[len(first) : turn], output[turn + len(second) : last], output[last + len(m) :]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def check_marks(marks: Sequence[str]) -> None:
    """Marks have to be found again: each begins with a character that occurs
    nowhere else in any of them, so none can begin inside another."""
    if len(set(marks)) != 3 or any(not m or any(m[0] in other[1:] for other in marks) for m in marks):
        raise ValueError(f"three different marks, whose first characters occur at their starts only, are needed: {marks}")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(table: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: Sequence[str] = MARKS, unit: str = UNIT, texts: bool = True) -> DataFrame:
    """One row per row of ``table`` (doc_id, text): doc_id, n (units), form
    (plain, psm or spm), prefix_chars and middle_chars in code points (null if
    plain), output (left out with ``texts`` off), output_sha256 and
    restored_sha256, the digest of the text read back from output and form.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these suffix
    first.  A null text counts as empty; an empty text and one that holds a
    mark stay plain.  A text without a line end is one unit, one of blanks or
    line ends is cut like any other.  A null id draws as an empty one; rows
    that share an id share their draws, and each stays a row.  The longest
    text is held a few times over in the task that has it, nothing more.  An
    empty table gives an empty result; other columns, whatever their names,
    are not read.
    """
    check_marks(marks)
    small_batches(table.sparkSession)
    kinds = "n long, form string, prefix_chars long, middle_chars long, " + "output string, " * texts + "output_sha256 string, restored_sha256 string"
    marks = tuple(marks)

    @pandas_udf(kinds)
    def rearranged(ids: pd.Series, documents: pd.Series) -> pd.DataFrame:
        units = regex.compile(unit)
        rows = []
        for doc_id, text in zip(ids, documents):
            ends = unit_ends(text, units)
            h1, h2, h3, h4 = draws(doc_id, seed)
            form, output, sizes = "plain", text, (None, None)
            if text and h3 % 100 < rate and not any(m in text for m in marks):
                form = "spm" if h4 % 100 < spm else "psm"
                low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
                a, b = (ends[at - 1] if at else 0 for at in (low, high))
                output, sizes = arrange(form, text[:a], text[a:b], text[b:], marks), (a, b - a)
            rows.append((len(ends), form, *sizes, *[output] * texts, sha256(output), sha256(restore(output, form, marks))))
        names = [kind.split()[0] for kind in kinds.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    plain = table.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("doc_id", rearranged("id", "text").alias("r")).select("doc_id", "r.*")
