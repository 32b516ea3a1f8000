"""Operators that depend on an order: carries, gaps, budgets, pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.sources.staging import stage


def first_missing(rows: DataFrame, by: str, number: str) -> DataFrame:
    """The least k >= 1 that is not among each group's numbers."""
    distinct = rows.filter(F.col(number) >= 1).select(by, number).distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy(number))
    run = distinct.withColumn("place", place).groupBy(by).agg(F.count_if(F.col(number) == F.col("place")).alias("n"))
    return rows.select(by).distinct().join(run, by, "left").select(by, (F.coalesce("n", F.lit(0)) + 1).alias("missing"))


def gaps(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Neighbouring numbers of a group that are more than one apart."""
    after = F.lead(number).over(Window.partitionBy(by).orderBy(number))
    return rows.select(by, number).distinct().withColumn("next", after).filter(F.col("next") - F.col(number) > 1)


def neighbours(rows: DataFrame, by: str, order: list[str], item: str) -> DataFrame:
    """Each item with the one that follows it."""
    after = F.lead(item).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("next", after).filter("next is not null").select(by, item, "next")


def carry_down(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Blank values take the last one above them."""
    filled = F.last(F.nullif(F.trim(value), F.lit("")), True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, filled)


def fill_both_ways(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Missing values take the one before, else the one after.

    Where nothing is before, what comes after is the first value of all, which
    one frame over the whole group gives; a frame from each row on would read
    the rest of the group for every row."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(before, first))


def runs_of(rows: DataFrame, by: str, order: list[str], begins: Column) -> DataFrame:
    """Number the runs of rows that each start where ``begins`` holds."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(begins.cast("int")).over(w))


def chunks(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Number fixed-size chunks from 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def _closings(size: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums before and after each row, and where the batch that starts at a row
    is closed (the number of rows if nowhere)."""
    after = np.cumsum(size)
    before = after - size
    return before, after, np.maximum(np.searchsorted(before, before, "right"), np.searchsorted(after, before + budget, "right"))


def budget_batches(rows: DataFrame, by: str, order: list[str], item: str, size: str, budget: int) -> DataFrame:
    """Close a batch when its sizes would pass ``budget``.  (by, item, batch).

    Rows are dealt in ordered ranges.  What a range makes of the open batch it
    is entered with depends on that batch's sum alone and in few steps; these
    steps are folded for each group, then each range numbers its own batches.
    A null size counts as none.
    """
    keys = [*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(item).alias("_i"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s")]
    names = [*(f"_o{k}" for k in range(len(order))), "_i", "_s"]
    dealt = stage(rows.select(F.col(by).alias("_by"), *keys).repartitionByRange("_by", *names).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part", "_by").orderBy(*names))
    placed = dealt.select("_by", "_part", place.alias("_n"), "_i", "_s")
    group = dict(dealt.dtypes)["_by"]

    def steps(table: pa.Table) -> pa.Table:
        """What follows from entering with a sum over ``above`` (-1: with none)."""
        table = table.sort_by("_n")
        x = table["_s"].to_numpy()
        before, after, closed = _closings(x, budget)
        n = len(x)
        count, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = closed[i]
            count[i], tail[i] = (count[j] + 1, tail[j]) if j < n else (0, after[-1] - before[i])
        last = np.concatenate([[-1], after[:-1]])
        first = np.flatnonzero((last < budget) & (after > last))
        above = np.concatenate([[-1], budget - after[first]])
        made = {"above": above, "count": np.concatenate([count[:1], count[first] + 1]), "tail": np.concatenate([tail[:1], tail[first]]), "total": np.full(len(above), after[-1])}
        return pa.table({"_by": table["_by"].take(pa.array([0] * len(above))), "_part": pa.array([table["_part"][0].as_py()] * len(above), pa.int32()), **{"start": pa.array([True] + [False] * len(first))}, **{k: pa.array(v) for k, v in made.items()}})

    def enter(table: pa.Table) -> pa.Table:
        """The sum and the batch with which each range of a group is entered."""
        parts: dict = {}
        for r in table.drop_columns(["_by"]).to_pylist():
            parts.setdefault(r["_part"], []).append(r)
        carry, batch, out = 0, 0, []
        for part in sorted(parts):
            out.append((part, carry, batch))
            if carry:
                hit = max((r for r in parts[part] if not r["start"] and r["above"] < carry), key=lambda r: r["above"], default=None)
            else:
                hit = next(r for r in parts[part] if r["start"])
            carry, batch = (hit["tail"], batch + hit["count"]) if hit else (carry + parts[part][0]["total"], batch)
        part, carries, batches = zip(*out)
        return pa.table({"_by": table["_by"].take(pa.array([0] * len(out))), "_part": pa.array(part, pa.int32()), "carry": pa.array(carries, pa.int64()), "first": pa.array(batches, pa.int64())})

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        _, after, closed = _closings(table["_s"].to_numpy(), budget)
        carry, starts = table["carry"][0].as_py(), []
        j = int(np.searchsorted(after, budget - carry, "right") if carry else closed[0])
        while j < len(after):
            starts.append(j)
            j = int(closed[j])
        batch = table["first"][0].as_py() + np.searchsorted(np.array(starts, np.int64), np.arange(len(after)), "right")
        return pa.table({"_by": table["_by"], "_i": table["_i"], "batch": pa.array(batch.astype(np.int32))})

    moves = placed.groupBy("_part", "_by").applyInArrow(steps, f"_by {group}, _part int, start boolean, above long, count long, tail long, total long")
    entered = moves.groupBy("_by").applyInArrow(enter, f"_by {group}, _part int, carry long, first long").withColumnsRenamed({"_by": "_g", "_part": "_p"})
    rows = placed.join(entered, (F.col("_part") == F.col("_p")) & F.col("_by").eqNullSafe(F.col("_g"))).drop("_g", "_p")
    numbered = rows.groupBy("_part", "_by").applyInArrow(number, f"_by {group}, _i {dict(dealt.dtypes)['_i']}, batch int")
    return numbered.select(F.col("_by").alias(by), F.col("_i").alias(item), "batch")


def top_within_budget(rows: DataFrame, by: str, score: str, tie: str, cost: str, budget: int) -> DataFrame:
    """Best-scored rows while their summed cost fits; at least one a group."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return ranked.filter((F.col("spent") <= budget) | (F.col("place") == 1))


def best_of(rows: DataFrame, by: list[str], score: Column, tie: list[Column]) -> DataFrame:
    """The best-scored row of each group, the first on ties."""
    w = Window.partitionBy(*by).orderBy(score.desc(), *tie)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_seen(rows: DataFrame, by: str, position: str, item: str) -> DataFrame:
    """Distinct items of a group ranked by first position."""
    firsts = rows.groupBy(by, item).agg(F.min(position).alias("at"))
    return firsts.select(by, item, F.dense_rank().over(Window.partitionBy(by).orderBy("at")).alias("rank"))


def renumber_duplicates(rows: DataFrame, by: str, position: str, number: str) -> DataFrame:
    """Colliding numbers of a group get the least unused positive integers, in
    order: the first holder of a number keeps it.  Missing numbers collide like
    any other, so but for the first each gets one.

    The k-th repeat gets k plus the used numbers that have fewer than k unused
    ones below them, which one running count over both tells.
    """
    same = Window.partitionBy(by, number).orderBy(position)
    order = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_again", (F.row_number().over(same) > 1).cast("int"))
    marked = marked.withColumn("_k", F.when(F.col("_again") == 1, F.sum("_again").over(order)))
    used = rows.filter(F.col(number) >= 1).select(by, number).distinct()
    unused_below = F.col(number) - F.row_number().over(Window.partitionBy(by).orderBy(number))
    used = used.select(by, (unused_below + 1).alias("_k"), F.lit(1).alias("_used"))
    repeats = marked.filter("_again = 1").select(by, "_k", F.lit(0).alias("_used"))
    counted = Window.partitionBy(by).orderBy("_k", F.desc("_used")).rowsBetween(Window.unboundedPreceding, 0)
    fresh = used.unionByName(repeats).withColumn("_fresh", F.col("_k") + F.sum("_used").over(counted)).filter("_used = 0").drop("_used")
    return marked.join(fresh, [by, "_k"], "left").withColumn(number, F.when(F.col("_again") == 1, F.col("_fresh")).otherwise(F.col(number)).cast("int")).select(*rows.columns)
