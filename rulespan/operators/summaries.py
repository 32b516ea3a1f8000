"""Choices and counts over what was read: main tables, columns, documents, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of column names in a revision sheet.
REVISION_COLUMNS = {
    "version": ("version", "rev", "release"),
    "revision_date": ("date", "effective", "updated", "as of"),
    "changed_by": ("by", "user", "author", "owner", "updated by", "modified by"),
    "notes": ("change", "notes", "description", "summary", "comment", "remarks", "updates"),
}


def primary_tables(candidates: DataFrame) -> DataFrame:
    """The main step table of each document (doc_id, tbl, first_step, n_steps): one
    that starts at 1 before others, then the longest, then the first."""
    best = F.max_by("tbl", F.struct((F.col("first_step") == 1).alias("one"), F.col("n_steps").alias("n"), (-F.col("tbl")).alias("first")))
    return candidates.groupBy("doc_id").agg(best.alias("tbl"), F.count("*").alias("candidates"))


def revision_columns(columns: DataFrame) -> DataFrame:
    """Per sheet (sheet_id, position, name) the column that fits each standard
    field best: its name is a known word, or holds one; the first of equals."""
    name = F.lower(F.trim("name"))
    rows = columns
    for field, words in REVISION_COLUMNS.items():
        held = F.lit(False)
        for w in words:
            held = held | name.contains(w)
        rows = rows.withColumn(f"_{field}", F.when(name.isin(*words), 2).when(held, 1).otherwise(0))
    pick = lambda f: F.max_by(F.when(F.col(f"_{f}") > 0, F.col("name")), F.struct(F.col(f"_{f}"), -F.col("position"))).alias(f)
    return rows.groupBy("sheet_id").agg(*(pick(f) for f in REVISION_COLUMNS))


def latest_documents(documents: DataFrame) -> DataFrame:
    """The last document (sop_id, url, title, position) of each address, or of
    each title where there is none."""
    key = F.coalesce(F.nullif(F.trim(F.coalesce("url", F.lit(""))), F.lit("")), F.nullif("title", F.lit("")), F.concat(F.lit("sop:"), F.col("sop_id").cast("string")))
    keyed = documents.withColumn("_key", key)
    last = Window.partitionBy("_key").orderBy(F.desc("position"))
    return keyed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_key", "_n")


def store_counts(sops: DataFrame, steps: DataFrame, rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Per procedure (sop_id) how many distinct steps (sop_id, step_number), rules
    (sop_id, rule_key) and codes (sop_id, code) a store holds.  Children are
    counted before they are joined."""
    out = sops.select("sop_id")
    for table, item, name in ((steps, "step_number", "steps"), (rows, "rule_key", "rules"), (codes, "code", "codes")):
        out = out.join(table.groupBy("sop_id").agg(F.countDistinct(item).alias(name)), "sop_id", "left")
    return out.fillna(0, ["steps", "rules", "codes"])


def fidelity(bound: DataFrame, decisions: DataFrame, preconditions: DataFrame) -> DataFrame:
    """Per procedure the rules bound to the canvas (sop_id) against those to be
    expected: its decisions (sop_id, step_number) and, where it has no step 0,
    the rules of its preconditions (sop_id, n_rules)."""
    have = bound.groupBy("sop_id").agg(F.count("*").alias("bound"))
    rows = decisions.groupBy("sop_id").agg(F.count("*").alias("n"), F.bool_or(F.col("step_number") == 0).alias("zero"))
    pre = preconditions.groupBy("sop_id").agg(F.sum("n_rules").alias("pre"))
    joined = have.join(rows, "sop_id", "full").join(pre, "sop_id", "full").fillna(0, ["bound", "n", "pre"])
    expected = F.col("n") + F.when(F.coalesce("zero", F.lit(False)), 0).otherwise(F.col("pre"))
    return joined.select("sop_id", "bound", expected.alias("expected"), (F.col("bound") == expected).alias("ok"))
