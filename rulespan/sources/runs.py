"""Runs and their rows saved together or not at all.

Every save writes its tables to folders of its own name.  One row in the
manifest, written last, makes them count: readers take only what it lists.  A
save that is cut off leaves folders that no one reads; one that fails leaves
its runs as FAILED, with the error and without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
MANIFEST = "save string, outcome string, error string"
MOST_ERROR = 2000


def save_runs(folder: str, runs: DataFrame, children: Mapping[str, DataFrame]) -> str:
    """Save ``runs`` (run_id, status, ...) with their ``children`` by table name
    below ``folder``, and return the outcome, SAVED or FAILED.

    A run that is still RUNNING is saved as COMPLETED.  A failed child fails
    the whole save: its runs are saved as FAILED instead.  If that cannot be
    written either, the error is raised and nothing counts.
    """
    spark, save = runs.sparkSession, uuid.uuid4().hex
    ended = runs.withColumn("status", F.when(c("status") == "RUNNING", "COMPLETED").otherwise(c("status"))).withColumn("error_message", F.lit("").cast("string"))
    outcome, error = "SAVED", ""
    try:
        for name, rows in children.items():
            rows.write.parquet(f"{folder}/{name}/save={save}")
        ended.write.parquet(f"{folder}/runs/save={save}")
    except Exception as why:  # whatever stops a child stops the run
        outcome, error = "FAILED", f"{type(why).__name__}: {why}"[:MOST_ERROR]
        save = f"{save}-failed"
        ended.withColumns({"status": F.lit("FAILED"), "error_message": F.lit(error)}).write.parquet(f"{folder}/runs/save={save}")
    spark.createDataFrame([(save, outcome, error)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return outcome


def saved(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table that the manifest lists: of ``runs`` those of every
    save, of others those of saves that went through."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    listed = manifest if name == "runs" else manifest.filter("outcome = 'SAVED'")
    return spark.read.parquet(f"{folder}/{name}").join(listed.select("save").distinct(), "save", "left_semi").drop("save")
