"""Fixtures of the text operators: odd rows and brute-force readings."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, key string, h long, label int, entries string"
WORDS = [a + b for a in "ka lo mi ne ru sta tor vel wi zo".split() for b in "da fin gor hal jet lum mar nok pel sur".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null columns, empty, blank, one-word and very long texts, ties, repeats,
    non-Latin text, and values in columns whose names the operators use inside."""
    copy = prose(5, 120)
    rows = [
        (1, prose(1, 80), "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n \x0b\x0c\r ", "en", ""),
        (5, "word", "de", "b"),
        (6, prose(6, 30_000), "en", "b"),
        (7, copy, "en", "c"),
        (8, copy, "en", "c"),
        (7, copy, "en", "c"),
        (7, copy, "en", "c"),
        (None, copy, None, "c"),
        (None, prose(9, 60), "fr", None),
        (None, None, None, None),
        (9, "日本語 テキスト " * 30, "ja", "d"),
        (10, "... !!! ???", "en", "d"),
        (11, "a\x1cb c d e f " * 12, "en", "d"),
        (-12, prose(12, 50) + "\n" + prose(13, 50), "en", "Ä"),
    ]
    return [(*r, len(r[1] or ""), 10**12, -1, "k", 5, 7, "x") for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
