"""Fuzzy name matching as vectorised UDFs over a bounded list of names."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.values import clean_name

THRESHOLD = 80.0
DEFAULT = "Standard Medicare"


@lru_cache(100_000)
def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks, in percent."""
    return SequenceMatcher(None, a, b).ratio() * 100


def similarity_percent(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p or "", q or "") for p, q in zip(x, y)])

    return ratio(a, b)


def _by_words(words: list[str], topics: list[tuple[str, list[str]]], threshold: float) -> tuple[str | None, float]:
    """Most matched words, then summed and best similarity, then how early the
    first word is met."""
    ranked = []
    for place, (name, parts) in enumerate(topics):
        free, hits = list(parts), []
        for w in dict.fromkeys(words):
            met = next((p for p in free if similarity(w, p) >= threshold), None)
            if met is not None:
                hits.append(similarity(w, met))
                free = [p for p in free if p != met]
        if hits:
            firsts = [(i, similarity(words[0], p)) for i, p in enumerate(parts)]
            near = [(-s, i) for i, s in firsts if s >= threshold]
            score, at = min(near) if near else (0.0, 999)
            ranked.append((-len(hits), -sum(hits), -max(hits), at, score, place, name, max(hits)))
    return (ranked and (min(ranked)[-2], min(ranked)[-1])) or (None, 0.0)


def _by_cosine(text: str, names: list[str]) -> list[float]:
    """Cosines of smoothed tf-idf vectors of words of two letters or more."""
    bags = [Counter(re.findall(r"\w\w+", t.lower())) for t in [text, *names]]
    seen = Counter(w for bag in bags for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
    vectors = [{w: n * idf[w] for w, n in bag.items()} for bag in bags]
    norms = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
    return [sum(x * v.get(w, 0.0) for w, x in vectors[0].items()) / (norms[0] * n) for v, n in zip(vectors[1:], norms[1:])]


def match_name(text: Column, names: list[str], default: str = DEFAULT, threshold: float = THRESHOLD) -> Column:
    """struct(name, similarity): by words, else by tf-idf, else the default.

    Names are the entries of a reference list and go to the tasks.
    """
    clean = lambda s: re.sub("[^A-Za-z ]", "", re.split(r"\$|\d|\bHMO\b", s, flags=re.I)[0]).upper().strip()
    cleaned = [clean(n) for n in names]
    topics = [(n, c.split()) for n, c in zip(names, cleaned)]

    @F.pandas_udf("name string, similarity double")
    def match(column: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for t in column.fillna(""):
            if t not in known:
                name, score = _by_words(t.split(), topics, threshold) if t else (None, 0.0)
                if name is None and t and any(cleaned):
                    cosines = _by_cosine(t, cleaned)
                    best = max(range(len(names)), key=lambda i: (cosines[i], -i))
                    name, score = (names[best], cosines[best] * 100) if cosines[best] * 100 >= threshold else (None, 0.0)
                known[t] = (name or default, round(score, 2))
            out.append(known[t])
        return pd.DataFrame(out, columns=["name", "similarity"])

    return match(clean_name(text))
