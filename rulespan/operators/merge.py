"""Idempotent writes: what a table holds after a batch of changes.

Each function returns the new content; the caller overwrites the table (or
the touched partitions) with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_blank: tuple[str, ...] = ()) -> DataFrame:
    """New rows win; a blank new value of ``keep_if_blank`` leaves the old one."""
    names = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*names).alias("_a"))
    b = new.select(*keys, F.struct(*names).alias("_b"))
    joined = a.join(b, keys, "full")
    pick = lambda n: F.when(F.col("_b").isNull(), F.col(f"_a.{n}")).otherwise(F.coalesce(F.nullif(F.col(f"_b.{n}"), F.lit("")), F.col(f"_a.{n}")) if n in keep_if_blank else F.col(f"_b.{n}")).alias(n)
    return joined.select(*keys, *(pick(n) for n in names))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the new rows, one a key, that it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def latest_wins(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key, and whether it replaced an earlier one."""
    w = Window.partitionBy(*keys)
    ranked = events.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("updated", F.count("*").over(w) > 1)
    return ranked.filter("_n = 1").drop("_n")


def toggles(events: DataFrame, keys: list[str], flag: str, position: str) -> DataFrame:
    """State of each key after events that set a flag or, where it is missing,
    flip it: the last set value, flipped as often as flips came after it."""
    last_set = F.max(F.when(F.col(flag).isNotNull(), F.col(position))).over(Window.partitionBy(*keys))
    base = F.coalesce(F.max_by(flag, F.when(F.col(flag).isNotNull(), F.col(position))), F.lit(False))
    later = F.count_if(F.col(flag).isNull() & (F.col(position) > F.coalesce("_set", F.lit(-1))))
    return events.withColumn("_set", last_set).groupBy(*keys).agg(F.when(later % 2 == 1, ~base).otherwise(base).alias("excluded"))


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Groups that the batch brings replace theirs as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def promote_preconditions(sections: DataFrame) -> DataFrame:
    """Rows of a synthetic step 0 from section rules (sop_id, section_pos, rules
    array of struct<kind, condition, action, is_exception>): exceptions and the
    deciding kinds, in order."""
    rule = F.upper(F.coalesce("r.kind", F.lit("")))
    kind = F.when(rule == "OVERRIDE", "BYPASS").when(rule.isin("ELIGIBILITY", "NOTE"), "CONDITIONAL").otherwise(rule)
    rows = sections.select("sop_id", "section_pos", F.posexplode("rules").alias("rule_pos", "r"))
    kept = rows.filter(F.coalesce("r.is_exception", F.lit(False)) | rule.isin("DENY", "ALLOW", "BYPASS", "OVERRIDE", "ELIGIBILITY"))
    row = F.row_number().over(Window.partitionBy("sop_id").orderBy("section_pos", "rule_pos")) - 1
    return kept.select("sop_id", F.lit(0).alias("step_number"), row.alias("row_index"), F.col("r.condition").alias("condition_if"), F.col("r.action").alias("action"), kind.alias("decision_type"))


def limit_basis(basis: Column) -> Column:
    b = F.upper(F.trim(F.coalesce(basis, F.lit(""))))
    return F.when(b.isin("DOS", "PAID_DATE", "EOB_DATE"), b).otherwise("DOS")


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions ``by`` that ``rows`` holds and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
