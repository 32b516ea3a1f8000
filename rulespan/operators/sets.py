"""Set operations and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_content(rows: DataFrame, content: str, position: str) -> DataFrame:
    """The first row of each content, with the hash; the whole content decides."""
    full = F.sha2(F.coalesce(content, F.lit("")), 256)
    firsts = rows.select(full.alias("digest"), F.col(position).alias("_at")).groupBy("digest").agg(F.min("_at").alias(position))
    return firsts.select(position, F.left("digest", F.lit(16)).alias("content_hash"))


def merge_in_order(rows: DataFrame, by: str, position: str, item: str) -> DataFrame:
    """Distinct items of each group by first position."""
    firsts = rows.groupBy(by, item).agg(F.min(position).alias("at"))
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item))), lambda x: x[item]).alias("codes"))


def backfill(have: DataFrame, want: DataFrame, keys: list[str], column: str, mark: str) -> DataFrame:
    """``have`` and the keys of ``want`` that it lacks, marked."""
    missing = want.join(have, keys, "left_anti").select(*keys, F.lit(mark).alias(column))
    return have.unionByName(missing)


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What turns ``old`` into ``new``: insert, delete, update or same, a key each."""
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    return a.join(b, keys, "full").withColumn("change", change).select(*keys, "change", F.col("_new").alias("row"))


def union_first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which the earlier table wins a key."""
    marked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    both = marked[0]
    for f in marked[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    names = [x for x in both.columns if x not in (key, "_rank")]
    best = both.groupBy(key).agg(F.min_by(F.struct(*names), "_rank").alias("r"))
    return best.select(key, "r.*")


def plans_of(rows: DataFrame, product: str) -> DataFrame:
    """Customers of a product with their distinct plans, sorted."""
    kept = rows.filter((F.col("product") == product) & (F.coalesce("customer", F.lit("")) != ""))
    return kept.groupBy("customer").agg(F.array_sort(F.collect_set(F.nullif("plan", F.lit("")))).alias("plans"))


def link_sets(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links not yet visited by address, once each."""
    return links.dropDuplicates(["url"]).join(visited.select("url"), "url", "left_anti")


