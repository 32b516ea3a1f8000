"""Operator 2: mix sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in each source.  A source whose target
passes its size takes every document once; what is left of its budget is
fitted as a bounded knapsack over the length counts, and documents are then
chosen by seeded order within each length.  Only lengths and counts are
shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.common import WORD_PATTERN, numbered, packed, stage, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SLACK = 1 << 16
RUN = 100_000


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as
    close to ``budget`` from below as the search can bring it.

    What the budget has over the table's size is spread evenly over the lengths
    and long ones fill it up; the bounded knapsack then picks, of all documents
    left, the largest sum that fits.  Its table is ``SLACK`` words and two of
    the longest document long, so a budget up to that is searched whole, and
    beyond there is room to do without any document that was spread.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    room = SLACK + 2 * int(lengths.max(initial=0))
    take = np.floor(counts * (max(0, budget - room) / max(1, total))).astype(np.int64)
    take[lengths <= 0] = 0
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0 and left > room:
            more = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    if left <= 0:
        return take
    # items of the bounded knapsack: powers of two of what is still there
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        free, size = min(int(counts[i] - take[i]), left // max(1, int(lengths[i]))), 1
        while lengths[i] > 0 and free > 0:
            n = min(size, free)
            items.append((int(i), n, n * int(lengths[i])))
            free, size = free - n, size * 2
    reach, inside, via = 1, (1 << (left + 1)) - 1, np.full(left + 1, -1, np.int32)
    for number, (_, _, weight) in enumerate(items):
        fresh = (reach << weight) & inside & ~reach
        if not fresh:
            continue
        bits = np.unpackbits(np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
        via[np.flatnonzero(bits)] = number
        reach |= fresh
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, n, weight = items[via[at]]
        take[i] += n
        at -= weight
    return take


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with a target each: the weights repeat over the
    sources in code point order, null last; no target passes ``most`` times its
    source, and what is over goes to the others by weight.

    The water level is read from running sums over the sources by how soon
    they fill; this is one row a source.
    """
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before, everywhere = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = share * F.sum("source_size").over(everywhere)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    levels = levels.withColumn("water", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w") + 1e-9, F.col("level"))).over(everywhere))
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("water"), F.col("level")) * F.col("w")).alias("target"))


def mix_groups(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """One row for all rows of ``docs`` (doc_id, text, source) that are equal in
    these three: doc_id, source, size, key (a hash of id and text), m (how many
    they are), more (how many of them the mix takes once more than the
    others), whole (how often it takes the others), source_size, target."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("key"))
    rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("m"))
    # the null source gets a key that no other source can have
    rows = stage(rows.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    lengths = stage(rows.groupBy("of", "source", "size").agg(F.sum("m").alias("n")), "lengths")
    goals = stage(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "goals")
    goals = goals.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    whole = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    goals = goals.withColumn("whole", whole).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        take = fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), int(part["budget"].iloc[0]))
        return pd.DataFrame({"of": part["of"], "size": part["size"], "take": take})

    picks = lengths.join(goals, "of").select("of", "size", "n", "budget").groupBy("of").applyInPandas(fit, "of string, size long, take long")
    placed = numbered(rows, ["of", "size"], F.xxhash64(F.lit(seed + 1), "key"), "m")
    chosen = placed.join(stage(picks, "picks"), ["of", "size"]).join(goals, "of")
    more = F.greatest(F.lit(0), F.least("m", F.col("take") - F.col("rank"))).cast("long")
    return chosen.select("doc_id", "source", "size", "key", "m", more.alias("more"), "whole", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, source,
    size, source_size, target, taken, times.

    ``times`` is how often the mix takes the row (0, 1 or 2), ``taken`` the
    words that makes.  A null text has size 0, a null source is a source of
    its own; equal rows are counted together and told apart by number only;
    empty documents are taken once in sources taken whole; an empty table
    gives an empty result.
    """
    groups = mix_groups(docs, weights, share, most, seed).withColumn("first", F.lit(0).cast("long")).withColumn("last", F.col("m") - 1)
    # a row that stands for very many is dealt out in runs before it is spread
    few = groups.filter(F.col("m") <= RUN)
    runs = groups.filter(F.col("m") > RUN).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(RUN).cast("long"))))
    runs = runs.withColumn("last", F.least("last", F.col("first") + RUN - 1)).repartition(F.col("key"), F.col("first"))
    each = few.unionByName(runs).withColumn("number", F.explode(F.sequence("first", "last")))
    times = F.col("whole") + F.when(F.col("number") < F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"))


def apply_mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``docs`` as mixed: rows that the mix takes twice come twice, those it leaves go.

    Rows equal in id, text and source fare alike but for the one group of a
    length in which the number to take runs out; only its rows are numbered.
    Columns of any name pass through.
    """
    groups = mix_groups(docs, seed=seed, **options).filter("whole > 0 or more > 0").select("key", F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), "m", "more", "whole")
    own_key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))
    held = docs.select(own_key.alias("key"), packed(docs))
    same = F.col("row").getField("doc_id").cast("long").eqNullSafe(F.col("of_id")) & F.col("row").getField("source").cast("string").eqNullSafe(F.col("of_source"))
    taken = held.join(groups, "key").filter(same).drop("of_id", "of_source")
    alike = taken.filter("more = 0 or more = m").select("row", (F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("times"))
    split = stage(taken.filter("more > 0 and more < m").withColumn("uid", F.monotonically_increasing_id()), "split")
    split = numbered(split, ["key"], F.xxhash64("uid")).select("row", (F.col("whole") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0)).alias("times"))
    return alike.union(split).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(*unpacked(docs))
